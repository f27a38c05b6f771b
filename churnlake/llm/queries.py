"""The registered query of each operator: production parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.llm import (
    compression_language, fill_in_middle, license_scan, line_frequency, main_text, mixing, near_copies, packing, prefix_trie,
    private_data, quartile_digest, repeated_phrases, toxic_terms)
from churnlake.llm.registry import query, table


@query("op1_line_frequency")
def op1(spark, sf):
    """Base counts of every text, and whether its lines are mostly boilerplate of its source."""
    out = line_frequency.verdicts(table(spark, sf, "documents"))
    return out.select("doc_id", *line_frequency.BASE, "base_failed", "kept", "words_removed")


@query("op2_packing")
def op2(spark, sf):
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_compression_language")
def op3(spark, sf):
    """Language of every text by the dictionary that compresses it best, learned outside the held-out fold."""
    docs = table(spark, sf, "documents")
    contents = compression_language.dictionaries(docs.filter(~compression_language.held_out("doc_id")))
    found = compression_language.identify(docs.select("doc_id", "text"), contents)
    return found.select("doc_id", compression_language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_main_text")
def op6(spark, sf):
    """Main text of every page."""
    return main_text.extract(table(spark, sf, "pages"))


@query("op4_toxic_terms")
def op4(spark, sf):
    """Toxicity of every text, learned outside the held-out fold."""
    docs = table(spark, sf, "documents")

    def held_out(key):
        return compression_language.held_out(key, 3, 1)

    labels = table(spark, sf, "labels").filter(~held_out("doc_id")).select("doc_id", "toxic")
    lexicon = toxic_terms.learn(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxic_terms.toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM src),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT *, first(lev) OVER (ORDER BY CASE WHEN cap >= w * lev THEN 0 ELSE 1 END, cap / w, lev ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM lev),
tgt AS (SELECT source, source_size, least(cap, w * level) AS target FROM fin),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
  CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS draw
  FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""


@query("op5_mixing", OP5_SQL)
def op5(spark, sf):
    """Words that the mix takes of every document."""
    out = mixing.with_copies(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


@query("op7_private_data")
def op7(spark, sf):
    """Personal data of every text: counts and digest of the base spans, and all spans."""
    found = private_data.find(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "pii")
    kinds = F.array(*map(F.lit, private_data.KINDS))

    def told(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    def base(pii):
        return F.filter(pii, lambda s: s["base"])

    def count(k):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(private_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(told(base(F.col("pii"))), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))


@query("op8_near_copies")
def op8(spark, sf):
    """Component of every document under links of similar two-word shingle sets."""
    return near_copies.near_copies(table(spark, sf, "documents"))


@query("op9_license_scan")
def op9(spark, sf):
    """Licenses of every text, with matched coverage and spans; a text without any has one row of nulls."""
    found = license_scan.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.inline_outer("licenses"))


@query("op10_quartile_digest")
def op10(spark, sf):
    """Digest of every text and of its edited text, and their likeness."""
    return quartile_digest.edited_pairs(table(spark, sf, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark, sf):
    """Every text cut at two line ranks and put together for filling in."""
    cut = fill_in_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"))


@query("op12_repeated_phrases")
def op12(spark, sf):
    """Words of every text outside passages of 35 words that stand in another place too."""
    clean = repeated_phrases.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY i) AS l FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM c),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM h a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT l[1:d] AS p, d, conv_id, len(l) AS n FROM r, unnest(range(0, len(l) + 1)) AS u(d)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON g.p = k.p),
a AS (SELECT p[1:e] AS q, CAST(sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].x) ELSE 0 END) AS BIGINT) AS saved_tokens,
  count(*) FILTER (n_children = 0) AS n_leaves FROM f, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends AS ends_sha256
FROM f JOIN a ON f.p = a.q LEFT JOIN g o ON f.d > 0 AND o.p = f.p[1:f.d - 1]
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf):
    """Nodes of the trie over the turns of all conversations with borrowed beginnings."""
    return prefix_trie.trie(prefix_trie.with_borrowed_beginnings(prefix_trie.named_turns(table(spark, sf, "conversations"))))
