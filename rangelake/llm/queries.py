"""The registered queries of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.llm import chat_rotation, collocations, conversation_repair, decontaminate, jaccard_join, license_scan, lm_scoring, quality_bands, retrieval_packing, secret_scan, substring_dedup, url_filter, warc_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(_table(spark, sf_dir, "conversations"))


SQL["op2_perspective_rotation"] = """
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM once WHERE role IS NOT NULL AND role <> 'system'),
kinds AS (
  SELECT o.*, s.perspective, o.role IS NOT DISTINCT FROM s.perspective AS own,
    CASE WHEN o.role IS NOT DISTINCT FROM s.perspective THEN 'assistant' WHEN o.role = 'system' THEN 'system' ELSE 'user' END AS as_role
  FROM once o JOIN speakers s ON o.conv_id IS NOT DISTINCT FROM s.c),
heads AS (
  SELECT *, CASE WHEN as_role = 'user' THEN '<|user:' || coalesce(role, '') || '|>' || chr(10) ELSE '<|' || as_role || '|>' || chr(10) END AS head,
    coalesce(text, '') || '<|end|>' AS told FROM kinds),
pieces AS (
  SELECT *, head || told || chr(10) AS piece,
    coalesce(sum(length(head) + length(told) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM heads)
SELECT conv_id, perspective, turn, as_role AS role, CASE WHEN as_role = 'user' THEN role END AS name, piece, start, start + length(piece) AS "end",
  CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(piece) - 1 END AS mask_end
FROM pieces
"""


@_query
def op3_content_addressed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_store.write_archive(_table(spark, sf_dir, "pages"))
    read = warc_store.parse_headers(warc_store.read_archive(spark, folder))
    return read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


SQL["op3_content_addressed_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


@_query
def op4_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages)))


@_query
def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_bands.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")


@_query
def op8_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


SQL["op8_benchmark_automaton"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM iw, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM items),
docs AS (
  SELECT k, s.size, i, array_to_string(w[i : i + s.size - 1], ' ') AS win
  FROM dw, sizes s, unnest(range(1, len(w) - s.size + 2)) AS t(i)),
hits AS (SELECT d.k, d.i, d.size, item_id FROM docs d JOIN items USING (size, win)),
found AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY k),
covered AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, i, size FROM hits), unnest(range(i, i + size)) AS t(j) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN found USING (k) LEFT JOIN covered USING (k)
"""


@_query
def op9_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    text = "coalesce(text, '')"
    parts = []
    for n, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        least = f"length(regexp_extract(h, '{pattern}', {rule.group})) >= {rule.least}"
        parts.append(
            f"""SELECT k, {n} AS o, '{rule.kind}' AS kind, start, start + length(h) AS stop FROM (
  SELECT k, h, sum(gap) OVER (PARTITION BY k ORDER BY i) + coalesce(sum(length(h)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT k, i, hs[i] AS h, length(gs[i]) AS gap FROM (
    SELECT k, regexp_extract_all({text}, '{pattern}') AS hs, regexp_split_to_array({text}, '{pattern}') AS gs FROM d), unnest(range(1, len(hs) + 1)) AS t(i)))
  WHERE {least}"""
        )
    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"coalesce(count(*) FILTER (o = {n}), 0)::BIGINT AS n_{r.kind}" for n, r in enumerate(secret_scan.BASE_RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT k, {counts}, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER (o < {base}) AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans FROM s GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)"""


SQL["op9_trigram_secret_scan"] = _secret_sql()


@_query
def op10_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op10_super_kmer_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS win FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
rep AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
gone AS (SELECT k, list_distinct(flatten(list(range(i, i + 35)))) AS js FROM win JOIN rep USING (win) GROUP BY k),
kept AS (SELECT k, doc_id, len(w) AS n, coalesce(len(js), 0) AS r, js, w FROM d LEFT JOIN gone USING (k)),
left_over AS (SELECT k, string_agg(w[j], ' ' ORDER BY j) AS t FROM (SELECT k, w, j FROM kept, unnest(range(1, n + 1)) AS t(j) WHERE js IS NULL OR NOT list_contains(js, j)) GROUP BY k)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN left_over USING (k)
"""


@_query
def op5_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), n=4, percent=85)


SQL["op5_count_vector_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a, min(doc_id) AS component_id FROM r JOIN d ON d.k = r.b GROUP BY r.a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (k) LEFT JOIN c ON c.a = d.k LEFT JOIN l ON l.a = d.k
"""


@_query
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


@_query
def op11_suffix_automaton_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


@_query
def op12_streamed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(_table(spark, sf_dir, "conversations"))


def _repair_sql() -> str:
    """The dynamic program as a recursion over turns; each of the four states carries its cheapest (cost, audit, repaired turns)."""

    def add(state: str, cost: str, letters: str, *turns: str) -> str:
        told = f"list_concat({state}.o, [{', '.join(turns)}])" if turns else f"{state}.o"
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letters}', o := {told})"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    user, both = ["'user:'"], ["'user:'", "'assistant:'"]
    inserts = f"""e, s, {least("u", add("e", "5", "I", *user), add("s", "5", "I", *user), add("a", "5", "I", *user))} AS u,
      {least("a", add("u", "5", "I", "'assistant:'"), add("e", "10", "II", *both), add("s", "10", "II", *both))} AS a"""
    keep = lambda state, letter: add(state, f"CASE WHEN forced OR letter <> '{letter}' THEN 1000000000 ELSE more END", "K", "role || ':' || text")
    turn = lambda state, role: add(state, "CASE WHEN forced THEN 1000000000 ELSE 1 + more END", "R", f"'{role}:' || text")
    drop = lambda state: add(state, "2", "D")
    never = "struct_pack(c := 2000000000::BIGINT, a := '', o := ['']::VARCHAR[])"
    return rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS fate FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 200), sha256(text)) AS pos,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, left(role, 1) AS letter FROM damaged),
marked AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup,
    letter || lead(letter) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM placed),
steps AS (
  SELECT *, blank OR dup AS forced, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    CASE WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 5 ELSE 0 END AS more FROM marked),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, struct_pack(c := 0::BIGINT, a := '', o := []::VARCHAR[]) AS e, {never} AS s, {never} AS u, {never} AS a FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL
  SELECT conv_id, pos, {drop("e")}, {least(drop("s"), keep("e", "s"))},
    {least(drop("u"), keep("e", "u"), keep("s", "u"), keep("a", "u"), turn("e", "user"), turn("s", "user"), turn("a", "user"))},
    {least(drop("a"), keep("u", "a"), turn("u", "assistant"))}
  FROM (SELECT t.conv_id, t.pos, role, text, letter, forced, more, {inserts} FROM walk w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1)),
ended AS (
  SELECT conv_id, {least("e", "a")} AS best FROM (
    SELECT conv_id, {inserts} FROM walk QUALIFY pos = max(pos) OVER (PARTITION BY conv_id))),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM x.conv_id
"""


SQL["op12_streamed_repair"] = _repair_sql()


@_query
def op13_ordered_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


SQL["op13_ordered_stream_collocations"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT k, lang, j, regexp_extract_all(ps[j], '[^\x20\x09]+') AS w FROM d, unnest(range(1, len(ps) + 1)) AS t(j)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, w[i : i + s - 1] AS g, count(*) AS f FROM p, unnest([1, 2, 3]) AS u(s), unnest(range(1, len(w) - s + 2)) AS t(i)
  GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, g, f AS a FROM g WHERE len(g) > 1),
cuts AS (SELECT lang, g, a, x, g[1 : x] AS one, g[x + 1 : len(g)] AS rest FROM c, unnest(range(1, len(g))) AS t(x)),
scored AS (
  SELECT q.lang, q.g, q.a, o.f AS l, r.f AS r, q.x, (1000000::HUGEINT * q.a * q.a // (o.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts q JOIN g o ON o.lang = q.lang AND o.g = q.one JOIN g r ON r.lang = q.lang AND r.g = q.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, x) = 1),
inner_pairs AS (SELECT lang, g[1:2] AS g, a FROM c WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE len(g) = 3),
longer AS (SELECT lang, g, max(a) AS m FROM inner_pairs GROUP BY 1, 2),
kept AS (SELECT z.* FROM lowest z LEFT JOIN longer USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * z.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
