"""The queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.centroids import CLUSTERS, COMPONENTS, ROUNDS, sort_means
from helixframe.llm.common import table
from helixframe.llm.exact_dedup import exact_dedup
from helixframe.llm.filter_audit import filter_audit
from helixframe.llm.fingerprints import document_fingerprints
from helixframe.llm.license_scan import EXCEPTION, IDENTIFIER, LONG, LOWER, MAX_GAP, PLAIN_ENDS, PLAIN_EXPRESSION, RESERVED, RULES, SENTENCES, STEPS, UPPER
from helixframe.llm.license_scan import license_scan, names_of, names_told, spdx_names
from helixframe.llm.mixing import mix
from helixframe.llm.packing import pack
from helixframe.llm.secrets import secret_scan
from helixframe.llm.simhash import near_dedup
from helixframe.llm.token_counts import encoded_lengths, length_histogram, with_truncation
from helixframe.llm.topk_search import KEPT, top_scores
from helixframe.llm.toxicity import score_toxicity, train
from helixframe.llm.url_filter import ALPHABET, HELD_OUT, LEAST_SEEN, ORDER, SCALE, SMOOTHING, filter_urls
from helixframe.llm.url_filter import RULES as URL_RULES


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("_key")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_tried", "n_novel", "n_base_novel")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_truncation(length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_license_scan,
        op3_simhash_near_dedup,
        op4_secret_scan,
        op5_token_counts,
        op6_toxicity,
        op7_mix_sources,
        op8_url_filter,
        op9_document_fingerprints,
        op10_best_fit_packing,
        op11_centroid_clustering,
        op12_exact_top_k,
        op13_filter_audit,
    )
}

_WS = r"[\x20\x09-\x0D]+"



def _license_sql() -> str:
    names = names_of(SENTENCES)
    known = ", ".join(f"('{sentence}', '{name}', {len(sentence.split()) >= LONG})" for sentence, name in names.items())
    steps, left, uses = [], "marks", {}
    for at, (name, rule) in enumerate(RULES):
        mark = "".join(f"<{i}>" for i in rule.split())
        steps.append(
            f"l{at} AS (SELECT *, replace({left}, '{mark}', '|') AS left{at}, "
            f"((length({left}) - length(replace({left}, '{mark}', '|'))) // {len(mark) - 1}) AS uses{at} FROM {f'l{at - 1}' if at else 'm'})"
        )
        left = f"left{at}"
        uses.setdefault(name, []).append(f"uses{at}")
    rights = f"<{RESERVED[1]}>"
    every = "+".join(x for u in uses.values() for x in u)
    alone = f"({every} = 0 AND len(listed) = 0)"
    number = lambda name: "+".join([*uses.get(name, []), f"len(list_filter(listed, lambda x: x = '{name}'))"])
    reserved = f"CASE WHEN {alone} THEN (length({left}) - length(replace({left}, '{rights}', ''))) // {len(rights)} ELSE 0 END"
    counts = {name: reserved if name == RESERVED[0] else number(name) for name in names_told()}
    told = ", ".join(f"CASE WHEN {n} > 0 THEN '{name}:' || ({n})::varchar END" for name, n in counts.items())
    left = f"CASE WHEN {alone} THEN replace({left}, '{rights}', '|') ELSE {left} END"
    spelled = "MAP {" + ", ".join(f"'{low}': '{name}'" for low, name in spdx_names().items()) + "}"
    marked = f"'|' || translate(coalesce(text, ''), '{UPPER}|', '{LOWER} ') || '|'"
    for pattern, mark in ((PLAIN_ENDS, STEPS[0][1]), *STEPS[1:]):
        marked = f"regexp_replace({marked}, '{pattern}', '{mark}', 'g')".replace("'\n'", "chr(10)")
    return rf"""
        WITH known(sentence, id, long) AS (VALUES {known}),
        d0 AS (
            SELECT row_number() OVER () AS rid, doc_id, {marked} AS m, {spelled} AS spelled,
                   regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_EXPRESSION}', 1) AS said FROM documents),
        d AS (
            SELECT rid, doc_id, m,
                   array_to_string(list_transform(said, lambda e: replace(replace(array_to_string(list_transform(regexp_extract_all(e, '[()]|{IDENTIFIER}'),
                       lambda p: CASE WHEN p IN ('or', 'and', 'with') THEN upper(p) ELSE coalesce(spelled[p], p) END), ' '), '( ', '('), ' )', ')')), '; ') AS spdx,
                   list_filter(flatten(list_transform(said, lambda e: list_transform(regexp_extract_all(regexp_replace(e, '{EXCEPTION}', '', 'g'), '{IDENTIFIER}'),
                       lambda p: spelled[p]))), lambda name: name IS NOT NULL) AS listed
            FROM d0),
        c AS (
            SELECT d.rid, d.m, known.sentence, known.id, known.long FROM d JOIN known ON contains(replace(d.m, chr(10), ' '), known.sentence)),
        b AS (
            SELECT rid, m, unnest(list_filter(range(1, length(m) + 1), lambda i: m[i] IN ('|', chr(10), ' '))) AS pos
            FROM (SELECT DISTINCT rid, m FROM c)),
        e AS (
            SELECT c.rid, b.pos, arg_max(c.id, length(c.sentence)) AS id, max(b.pos + length(c.sentence)) AS last
            FROM c JOIN b ON c.rid = b.rid AND (c.long OR b.m[b.pos] <> ' ') AND replace(substr(c.m, b.pos + 1, length(c.sentence)), chr(10), ' ') = c.sentence
                         AND substr(c.m, b.pos + 1 + length(c.sentence), 1) IN ('|', chr(10)) GROUP BY ALL),
        o AS (SELECT * FROM e WHERE NOT EXISTS (FROM e AS around WHERE around.rid = e.rid AND around.pos < e.pos AND e.pos < around.last)),
        g AS (
            SELECT b.rid, count(o.id) AS n_known, string_agg(o.id, ',' ORDER BY b.pos) AS sentence_ids,
                   string_agg(CASE WHEN o.id IS NOT NULL THEN '<' || o.id || '>' WHEN b.m[b.pos] = '|' THEN '.' ELSE '' END, '' ORDER BY b.pos) AS raw
            FROM b LEFT JOIN o ON b.rid = o.rid AND b.pos = o.pos GROUP BY b.rid),
        m AS (
            SELECT d.doc_id, d.spdx, d.listed, length(d.m) - length(replace(d.m, '|', '')) - 1 AS n_sentences, coalesce(g.n_known, 0) AS n_known, coalesce(g.sentence_ids, '') AS sentence_ids,
                   regexp_replace(regexp_replace(coalesce(g.raw, ''), '\.{{{MAX_GAP + 1},}}', '|', 'g'), '\.', '', 'g') AS marks
            FROM d LEFT JOIN g ON d.rid = g.rid),
        {", ".join(steps)}
        SELECT doc_id, n_sentences, n_known, sentence_ids, concat_ws(',', {told}) AS licenses,
               array_to_string(regexp_extract_all({left}, '<([^>]+)>', 1), ',') AS unmatched, spdx
        FROM l{len(RULES) - 1}
    """


def _url_sql() -> str:
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f.format(h + p) for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f.format(v) for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    room = SMOOTHING * ALPHABET
    held = ", ".join(f"'{x}'" for x in HELD_OUT)
    return rf"""
        WITH u AS (
            SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
                   CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        h AS (SELECT *, regexp_extract(rest, '\A[^/?#]*') AS raw_host FROM u),
        p AS (
            SELECT rid, page_id, translate(url, '{UPPER}', '{LOWER}') AS low, translate(raw_host, '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(substr(rest, length(raw_host) + 1), '\A[^?#]*') AS path
            FROM h),
        r AS (SELECT *, {rule} AS rule, {verdict} AS ruled, md5(low)[1] IN ({held}) AS held FROM p),
        f AS (
            SELECT rid, ruled, held, unnest(list_transform(range(1, length(low) + 1), lambda i: substr(repeat(chr(2), {ORDER}) || low, i, {ORDER + 1}))) AS gram4
            FROM r),
        c AS (
            SELECT size, right(gram4, size) AS gram, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad
            FROM f, range(1, {ORDER + 2}) s(size) WHERE ruled IS NOT NULL AND NOT held GROUP BY ALL),
        x AS (SELECT size, left(gram, size - 1) AS context, sum(good) AS all_good, sum(bad) AS all_bad FROM c GROUP BY ALL),
        m AS (
            SELECT c.gram, c.size, round({SCALE} * (ln((good + {SMOOTHING}::double) / (all_good + {room}::double)) - ln((bad + {SMOOTHING}::double) / (all_bad + {room}::double))))::bigint AS gain
            FROM c JOIN x ON c.size = x.size AND left(c.gram, c.size - 1) = x.context WHERE good + bad >= {LEAST_SEEN}),
        b AS (
            SELECT g.gram4, arg_max(m.gain, m.size) AS gain
            FROM (SELECT DISTINCT gram4 FROM f) g, range(1, {ORDER + 2}) s(size) JOIN m ON m.size = s.size AND m.gram = right(g.gram4, s.size) GROUP BY g.gram4),
        t AS (SELECT f.rid, floor(coalesce(sum(b.gain), 0)::double / count(*))::bigint AS score FROM f LEFT JOIN b ON f.gram4 = b.gram4 GROUP BY f.rid),
        a AS (SELECT r.*, coalesce(t.score, 0) AS score FROM r LEFT JOIN t ON r.rid = t.rid),
        k AS (SELECT (coalesce(avg(score) FILTER (ruled = 'allow' AND held), avg(score) FILTER (ruled = 'allow'))
                      + coalesce(avg(score) FILTER (ruled = 'block' AND held), avg(score) FILTER (ruled = 'block'))) / 2 AS threshold FROM a)
        SELECT page_id, host, path, rule,
               coalesce(ruled, CASE WHEN k.threshold IS NULL OR score >= k.threshold THEN 'allow' ELSE 'block' END) AS verdict
        FROM a, k
    """


#: Vectors of whole numbers, for SQL.
_WHOLE = """
    e AS (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS q
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _centroid_sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
            d{r} AS MATERIALIZED (
                SELECT v.rid, c.num, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint AS distance
                FROM v, c{r} c),
            a{r} AS MATERIALIZED (SELECT rid, min(distance) AS distance, arg_min(num, {{'d': distance, 'n': num}}) AS cluster FROM d{r} GROUP BY rid)""")
        if r < ROUNDS:
            rounds.append(f"""
            m{r} AS (
                SELECT cluster, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY pos) AS q
                FROM (SELECT a.cluster, i.pos, sum(v.q[i.pos]) AS s, count(*) AS n
                      FROM a{r} a JOIN v ON a.rid = v.rid, range(1, {COMPONENTS + 1}) i(pos) GROUP BY ALL) GROUP BY cluster),
            c{r + 1} AS MATERIALIZED (SELECT c.num, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.num)""")
    return f"""
        WITH {_WHOLE},
        v AS MATERIALIZED (SELECT * FROM e WHERE len(q) = {COMPONENTS}),
        c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::varchar) NULLS LAST, q) - 1)::int AS num, q FROM v QUALIFY num < {CLUSTERS}),
        {", ".join(rounds)}
        SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::bigint AS cluster_inertia,
               (sum(a.distance) OVER ())::bigint AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM v JOIN a{ROUNDS} a ON v.rid = a.rid JOIN c{ROUNDS} c ON c.num = a.cluster
    """


ORACLE_SQL = {
    "op11_centroid_clustering": _centroid_sql(),
    "op12_exact_top_k": f"""
        WITH {_WHOLE},
        s AS (
            SELECT a.rid, a.vec_id AS query_id, b.vec_id,
                   coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::bigint AS score
            FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 20 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST))::int AS rank, vec_id, score FROM s QUALIFY rank <= {KEPT}
    """,
    "op13_filter_audit": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
        l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   list_filter([CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
                                CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 'C' END,
                                CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' END, CASE WHEN least < d.doc_id THEN 'E' END], lambda y: y IS NOT NULL) AS fails
            FROM d JOIN f ON d.t = f.t LEFT JOIN l ON l.doc_id = d.doc_id),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (
            SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS letter, n, good, toxic, list_contains(fails, o[step]) AS failed,
                   list_has_any(fails, o[:step - 1]) AS gone, len(fails) AS bits
            FROM c, o, range(1, 6) r(step)),
        g AS (
            SELECT part, filter_order, step::int AS step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::bigint AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND failed), 0)::bigint AS removed, coalesce(sum(n) FILTER (gone AND failed), 0)::bigint AS redundant,
                   coalesce(sum(n) FILTER (failed AND bits = 1), 0)::bigint AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failed), 0)::bigint AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::bigint AS toxic_lost
            FROM s GROUP BY ALL)
        SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM g
    """,
    "op1_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op2_license_scan": _license_sql(),
    "op8_url_filter": _url_sql(),
    "op7_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':mix') AS order_key
            FROM documents),
        s AS (
            SELECT source, sum(size)::bigint AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
            FROM d GROUP BY source),
        f AS (
            SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::double * 3 / 2 AS budget,
                   coalesce(sum(2 * source_size) OVER w, 0)::double AS capped,
                   (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::double AS open_weight
            FROM s WINDOW w AS (ORDER BY (2 * source_size)::double / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, weight * ((budget - capped) / open_weight) >= cap AS is_capped FROM f),
        l AS (SELECT capped AS l_capped, budget AS l_budget, open_weight AS l_weight FROM c WHERE NOT is_capped ORDER BY capped LIMIT 1),
        t AS (
            SELECT source, source_size, CASE WHEN is_capped THEN cap::double ELSE (l_budget - l_capped) * weight / l_weight END AS target
            FROM c LEFT JOIN l ON true),
        r AS (
            SELECT d.*, t.source_size, t.target, floor(t.target)::bigint AS budget,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.doc_id, d.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before_words
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::bigint AS size, source_size, target,
               (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size
                                          - before_words)))::bigint AS taken
        FROM r
    """,
}
