"""Secret scan: patterns, and dictionary-primed zstandard novelty in sensitive contexts.

Besides the spans of three patterns, strings that follow a sensitive word are candidates.
A candidate is measured by the bytes that it adds to the compressed form of its
surroundings: the compressor is primed with a dictionary of usual identifiers and the text
around the candidate, so a word, a path or a name that was seen before adds little, while
a random string adds nearly its own length. Those that don't compress are reported too, and
the values of the patterns' spans are measured in the same way, to tell keys from placeholders.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import text_of

# The patterns and the lengths from which their matches count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # what [0-9a-f]+ finds, of 24 characters or more
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words that make the strings after them candidates, within so many characters.
SENSITIVE = re.compile(
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|bearer|auth|authorization|signature|client_?id|session(?:_?id)?|cookie|jwt|hmac|webhook)(?![a-z])",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "signature", "client", "session", "cookie", "jwt", "hmac", "webhook")
SHORTEST = 16
CANDIDATE, LONGER = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST), re.compile(r"[A-Za-z0-9+/_=-]*")
REACH = 48
#: Characters before and after a candidate that the compressor knows.
SURROUNDINGS = 512
#: Added bytes per character from which a candidate is novel.
NOVELTY = 0.7
#: Candidates are measured in pieces of about so many characters: from 64 literals on, zstandard codes them by
#: their frequencies, and a random string over a small alphabet would no longer add its own length.
PIECE = 48
# Identifiers as they are usual in code and configuration.
IDENTIFIERS = """
username user_name password passwd secret token api_key apikey access_key private_key public_key client_id client_secret
authorization bearer credentials signature session_id request_id response header cookie content-type application/json
get_password set_password check_token validate_token refresh_token access_token id_token token_type expires_in redirect_uri
example changeme placeholder your_password_here your_api_key_here insert_token_here xxxxxxxxxxxxxxxx 0000000000000000
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 config settings environment variable default
AuthenticationManager TokenProvider PasswordEncoder SecretManager CredentialsProvider getAccessToken setSecretKey
"""


class Novelty:
    """Bytes that a string adds to its compressed surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode()

    def added(self, candidate: str, around: str) -> int:
        known = zstandard.ZstdCompressionDict(self.identifiers + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        bare = around[-64:].encode()
        return len(packer.compress(bare + candidate.encode())) - len(packer.compress(bare))

    def share(self, text: str, start: int, end: int) -> float:
        """Added bytes per character of text[start:end], each piece of it after what stands before."""
        count = -(-(end - start) // PIECE)
        cuts, after = [start + (end - start) * i // count for i in range(count + 1)], text[end : end + SURROUNDINGS]
        return sum(self.added(text[a:b], after + text[max(0, a - SURROUNDINGS) : a]) for a, b in zip(cuts, cuts[1:], strict=False)) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, in code points, end exclusive; in order of start, then kind."""
    found, lowered = [], text.lower()
    if any(w in lowered for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def mixed(string: str) -> bool:
    """Whether it has two of lower case, upper case and digits; words of prose have one."""
    return sum(any(a <= c <= b for c in string) for a, b in ("az", "AZ", "09")) > 1


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Strings of 16 characters or more after a sensitive word that overlap no span of base, words of prose left out.

    Each word looks as far as its reach alone, and a string is read once however many words
    stand before it, so the time is linear in the text.
    """
    lowered = text.lower()
    if not any(w in lowered for w in _HINTS):
        return []
    starts = [a for a, _, _ in base]  # rising
    ends = list(accumulate((b for _, b, _ in base), max))
    found, after = [], 0
    for word in SENSITIVE.finditer(text):
        at, reach = max(word.end(), after), word.end() + REACH
        while at < reach and (m := CANDIDATE.search(text, at, reach + SHORTEST - 1)):  # what begins within reach is 16 characters by there
            start, end = m.start(), LONGER.match(text, m.end()).end()
            at = after = end
            before = bisect_left(starts, end)
            if mixed(text[start:end]) and not (before and ends[before - 1] > start):
                found.append((start, end))
    return found


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str]]:
    """The candidates that don't compress."""
    return [(a, b, "novel") for a, b in candidates(text, base) if novelty.share(text, a, b) >= least]


def value_of(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """Where the secret itself stands in a span of base."""
    start, end, kind = span
    return ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start, end)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _scan(texts: pd.Series) -> pd.DataFrame:
    novelty, rows = Novelty(), []
    for text in texts:
        base = base_spans(text)
        kinds = [kind for _, _, kind in base]
        tried = candidates(text, base)
        novel = [(a, b, "novel") for a, b in tried if novelty.share(text, a, b) >= NOVELTY]
        keys = sum(novelty.share(text, *value_of(text, span)) >= NOVELTY for span in base)
        rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(tried), len(novel), keys, joined(base), joined(base + novel)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])


COLUMNS = "n_assign long, n_access long, n_hex long, n_tried long, n_novel long, n_base_novel long, base string, spans string"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_assign, n_access, n_hex, n_tried, n_novel, n_base_novel, base, spans).

    base and spans are comma-joined kind:start:end, by start, then kind; spans also holds
    the novel strings. n_tried candidates were measured and n_novel of them reported;
    n_base_novel of the patterns' spans have a value that doesn't compress either. Candidates
    have two of lower case, upper case and digits, for a word of prose has one. A null or
    empty text has none: zeros and empty strings. Repeated rows are scanned each for itself;
    an empty table gives no rows; other columns are not read.
    """
    scan = F.pandas_udf(_scan, COLUMNS)
    return docs.select(F.col(id_col), scan(text_of(text_col)).alias("found")).select(id_col, "found.*")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
