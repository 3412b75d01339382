"""One query per operator over its whole table, and DuckDB SQL for those that SQL expresses.

Each query applies its operator with production parameters and derives its columns from the
operator's output.  ``ORACLE`` lacks the operators that SQL cannot express; tests hold those
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import chat, decontaminate, licenses, line_dedup, merkle, minhash, mixing, pii, quality, repair, substrings, toxicity, warc
from strata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f
    return keep


# --- 3: quality rules ---------------------------------------------------------------------
_STOP_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_BROKEN = " OR ".join(f"{r.count} {r.compare} {r.limit} * {r.per}" for r in quality.RULES)
_OP3_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri2 AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM tri),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri2),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({_STOP_LIST}))) AS n_stop_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_BROKEN}) AS kept FROM b
"""


@_register("op3_quality_rules", _OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.annotate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                         "n_repeat_words", "base_failed", "kept")


# --- 7: benchmark decontamination -----------------------------------------------------------
_OP7_WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
_OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP7_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_OP7_WORDS} AS ws FROM benchmark),
iw AS (SELECT item_id, least(len(ws), 13) AS l, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS g FROM iw),
dw AS (SELECT r, l, ws, unnest(range(1, len(ws) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l),
dg AS (SELECT r, l, s, array_to_string(ws[s:s + l - 1], ' ') AS g FROM dw),
hit AS (SELECT r, item_id, l, s FROM dg JOIN win USING (l, g)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@_register("op7_benchmark_decontamination", _OP7_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# --- 10: mixing -------------------------------------------------------------------------------
# Sampling weights by label: good, bad, and documents without a label.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.6
MIX_SEED = "mix-1"
_OP10_SQL = rf"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNKNOWN} END AS weight FROM documents LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s2 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
s3 AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s2),
s4 AS (SELECT *, max(CASE WHEN cap / w >= (total - capped) / open THEN (total - capped) / open END) OVER () AS water FROM s3),
t AS (SELECT source, source_size, least(cap, coalesce(water * w, cap)) AS target FROM s4),
t2 AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, t2.*, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t2 ON k.source IS NOT DISTINCT FROM t2.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken FROM r
"""


def label_weight():
    return F.when(F.col("label") == 1, GOOD).when(F.col("label") == 0, BAD).otherwise(UNKNOWN)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, size, quality`` with the sampling weights of the labelled documents."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    slim = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    return slim.join(known, "doc_id", "left").select("doc_id", "source", "size", label_weight().alias("quality"))


@_register("op10_mix_sources", _OP10_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mix(slim, seed=MIX_SEED).select("doc_id", "size", "source_size", "target", "taken")


# --- 8: near-duplicate documents ----------------------------------------------------------------
@_register("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# --- 1: chat formatting ---------------------------------------------------------------------------
_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
_OP1_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(6 + length({_ESC.format('role')}) + 7 + length({_ESC.format('text')}) + 4))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@_register("op1_chat_formatting", _OP1_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    return chat.read_back(chat.format_chats(turns.unionByName(spark.createDataFrame(forged, turns.schema))))


# --- 2: toxicity ------------------------------------------------------------------------------------
@_register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                                              "score", "predicted")


# --- 9: personal data -------------------------------------------------------------------------------
@_register("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = F.array(*[F.lit(k) for k in pii.KINDS])

    def listed(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[counted(k) for k in pii.KINDS[:4]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"))


# --- 6: web archives ----------------------------------------------------------------------------------
_BITS = "array_to_string([lpad(bin(('0x' || d)::INT), 4, '0') for d in string_split(sha1(html), '') if d <> ''], '')"
_OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS s, {_BITS} AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM b)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum([CASE WHEN substr(bits, 5 * g + k, 1) = '1' THEN (1 << (5 - k)) ELSE 0 END
    for k in [1, 2, 3, 4, 5]])::INT + 1, 1) for g in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@_register("op6_warc", _OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(warc.write_archives(pages)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


# --- 4: line dedup ------------------------------------------------------------------------------------
_OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d)),
w AS (SELECT r, doc_id, i, ls[i] AS s, list_filter(string_split_regex(lower(ls[i]), '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS ws FROM l),
t AS (SELECT r, doc_id, i, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
    [array_to_string(ws[j:j + 4], ' ') for j in range(1, len(ws) - 3)] END) AS t FROM w WHERE len(ws) > 0),
u AS (SELECT DISTINCT r, doc_id, i, t FROM t), n AS (SELECT r, doc_id, i, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT x.r, x.i, y.r AS yr, y.i AS yi, count(*) AS k FROM u x JOIN u y ON x.t = y.t AND (y.doc_id, y.i) < (x.doc_id, x.i) GROUP BY ALL),
gone AS (SELECT DISTINCT c.r, c.i FROM c JOIN n a ON a.r = c.r AND a.i = c.i JOIN n b ON b.r = c.yr AND b.i = c.yi
  WHERE 100 * k >= 80 * (a.n + b.n - k)),
o AS (SELECT w.r, w.i, w.s, len(ws) > 0 AS worded, gone.r IS NOT NULL AS gone FROM w LEFT JOIN gone USING (r, i))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (worded)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM o JOIN d USING (r) GROUP BY r
"""


@_register("op4_line_dedup", _OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# --- 5: license scans -----------------------------------------------------------------------------------
_SQL_TEMPLATES = ", ".join("('%s', ['%s'])" % (k, "', '".join(licenses.template_pairs(licenses.template_words(v))))
                           for k, v in sorted(licenses.TEMPLATES.items()))
_OP5_SQL = rf"""
WITH t(license, pairs) AS (VALUES {_SQL_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\n[\x20\x09\r]*\n') || [text])) AS u FROM d),
w AS (SELECT r, u, list_filter(string_split_regex(lower(u), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM u),
b AS (SELECT r, u, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS b FROM w),
m AS (SELECT r, license, 2.0::DOUBLE * len(list_intersect(b, pairs)) / (len(b) + len(pairs)) AS dice FROM b JOIN t
  ON 120 * len(b) >= 80 * len(pairs) AND 80 * len(b) <= 120 * len(pairs)),
k AS (SELECT r, count(*)::BIGINT AS n, max(dice) AS dice, first(license ORDER BY dice DESC, license) AS best,
  array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM m WHERE 100 * dice >= 80 GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, best AS license, round(dice, 6) AS dice, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN k USING (r)
"""


@_register("op5_license_scan", _OP5_SQL)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("licenses", F.lit(0))
    names = F.array_sort(F.array_distinct(F.col("licenses.license")))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), best["license"].alias("license"),
                      F.round(best["dice"], 6).alias("dice"), F.array_join(names, ",").alias("licenses"))


# --- 11: Merkle manifest ----------------------------------------------------------------------------------
def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text, from a table of 256 values made by the polynomial."""
    return (f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT), "
            "lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)")


_CRC_TABLE = ("(SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: "
              "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS c FROM range(256) t(i)))")


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(%s)" % " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR END" for v in values)


_OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS claimed
  FROM documents, {_CRC_TABLE}),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
n(g, l, i, h, m) AS (SELECT g, 0, i, leaf, m FROM p UNION ALL
  (SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM n WHERE m > 1 GROUP BY g, l, i // 2, m)),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM n WHERE m = 1),
t(l, i, h, m) AS (SELECT 0, i, h, m FROM s UNION ALL
  (SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM t WHERE m > 1 GROUP BY l, i // 2, m)),
f(r, g, l, i, m, h, proof) AS (SELECT r, g, 0, i, m, claimed, '' FROM p UNION ALL
  SELECT f.r, f.g, f.l + 1, f.i // 2, (f.m + 1) // 2,
    sha256(CASE WHEN n.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN n.h || f.h ELSE f.h || n.h END), f.proof || coalesce(n.h, '')
  FROM f LEFT JOIN n ON n.g = f.g AND n.l = f.l AND n.i = f.i + 1 - 2 * (f.i % 2) WHERE f.m > 1),
u(r, l, i, m, h, proof) AS (SELECT f.r, 0, s.i, s.m, f.h, f.proof FROM f JOIN s USING (g) WHERE f.m = 1 UNION ALL
  SELECT u.r, u.l + 1, u.i // 2, (u.m + 1) // 2,
    sha256(CASE WHEN t.h IS NULL THEN u.h WHEN u.i % 2 = 1 THEN t.h || u.h ELSE u.h || t.h END), u.proof || coalesce(t.h, '')
  FROM u LEFT JOIN t ON t.l = u.l AND t.i = u.i + 1 - 2 * (u.i % 2) WHERE u.m > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, top.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = top.h AS verified
FROM p JOIN s USING (g) JOIN u ON u.r = p.r AND u.m = 1, (SELECT h FROM t WHERE m = 1) AS top
"""


@_register("op11_merkle_manifest", _OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    raised = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    claimed = F.when(altered, raised).otherwise(merkle.leaf([F.col(c) for c in merkle.FIELDS]))
    return merkle.verify(merkle.manifest(docs, claimed=claimed))


# --- 12: conversation repair --------------------------------------------------------------------------------
# Cost vectors are lists over the states nothing yet, after system, after user, after assistant.
def _cheapest_sql(state: int, after: int, v: str) -> str:
    """The least cost of a row's own edits from ``state``; ``after``: the state of one more row."""
    keep = {1: f"CASE role WHEN 's' THEN {v}[2] WHEN 'u' THEN {v}[3] END", 2: f"CASE role WHEN 'u' THEN {v}[3] END",
            3: f"CASE role WHEN 'a' THEN {v}[4] END", 4: f"CASE role WHEN 'u' THEN {v}[3] END"}[state]
    return (f"least(2 + {v}[{state}], CASE WHEN kind < 2 THEN 5 * kind + least(coalesce({keep}, 1000000), 1 + {v}[{after}]) "
            f"ELSE 1000000 END)")


_STATES = ((1, 3), (2, 3), (3, 4), (4, 3))  # each state, and the state after one more user or assistant row
_OWN = ", ".join(_cheapest_sql(s, t, "v") for s, t in _STATES)
_CLOSED = ", ".join(f"least(o[{s}], 5 + o[{t}], 10 + o[{dict(_STATES)[t]}])" for s, t in _STATES)
_AFTER = "CASE q WHEN 3 THEN 4 ELSE 3 END"
_KEPT = "CASE WHEN role = 's' AND q = 1 THEN 2 WHEN role = 'u' AND q <> 3 THEN 3 WHEN role = 'a' AND q = 3 THEN 4 END"
_OP12_SQL = rf"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations, {_CRC_TABLE}),
y AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM y),
z AS (SELECT conv_id, i, n, turn, role AS name, text, left(role, 1) AS role,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    CASE WHEN fault = 'truncated' THEN 1 WHEN fault IS NULL THEN 0 ELSE 2 END AS kind,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM r),
b(conv_id, i, v) AS (SELECT DISTINCT conv_id, n + 1, [0, 10, 5, 0] FROM z UNION ALL
  SELECT conv_id, i, [{_CLOSED}] FROM (SELECT z.conv_id, z.i, [{_OWN}] AS o FROM b JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.i = b.i - 1)),
t(conv_id, i, q, cost, audit, fixed, n) AS (SELECT DISTINCT conv_id, 1::BIGINT, 1, 0, '', []::VARCHAR[], n FROM z UNION ALL
  SELECT conv_id, CASE WHEN op = 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN q WHEN 'K' THEN kept ELSE after END,
    cost + CASE op WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN 5 * kind ELSE 1 + 5 * kind END, audit || op,
    CASE op WHEN 'D' THEN fixed WHEN 'K' THEN list_append(fixed, name || ':' || text)
      ELSE list_append(fixed, CASE after WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE op WHEN 'R' THEN text ELSE '' END) END, n
  FROM (SELECT *, CASE WHEN i <= n AND 2 + w[q] = v[q] THEN 'D' WHEN 5 + v[after] = v[q] THEN 'I'
      WHEN i <= n AND kind < 2 AND 5 * kind + w[kept] = v[q] THEN 'K' ELSE 'R' END AS op
    FROM (SELECT t.*, b.v, w.v AS w, z.role, z.name, z.text, z.kind, {_AFTER} AS after, {_KEPT} AS kept
      FROM t JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.i
      LEFT JOIN b w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i + 1
      LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND z.i = t.i
      WHERE t.i <= t.n OR q IN (2, 3)))),
e AS (SELECT * FROM t WHERE i = n + 1 AND q IN (1, 4)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
    count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
    count(*) FILTER (i > 1 AND prior || role NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM z GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(fixed, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@_register("op12_conversation_repair", _OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_all(repair.damage(turns), turns)


# --- 13: substring dedup --------------------------------------------------------------------------------------
_OP13_SQL = rf"""
WITH w AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 18)) AS s, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT r, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY r, s) AS nth FROM g),
p AS (SELECT r, list(DISTINCT q) AS gone FROM (SELECT r, unnest(range(s, s + 20)) AS q FROM h WHERE nth > 1) GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) o
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS q FROM p) x WHERE x.r = o.r AND x.q = o.i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN p USING (r) LEFT JOIN k USING (r)
"""


@_register("op13_substring_dedup", _OP13_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"))
