"""The registered queries of this package and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelspark.llm import (
    ann, decontaminate, divergence, embedding_dup, interactions, mixing, near_dup, pii, secrets, sharding, token_files, tool_calls, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = model.score(docs, name="score")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


# Parameters of the tools that op4 derives from conversations.
SCHEMAS: tool_calls.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False), "after": ("object", False)},
    "fetch": {"query": ("string", True), "limit": ("integer", True), "after": ("object", False)},
    "note": {"query": ("string", True), "after": ("object", False)},
}


@_query
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn read as a tool call, every assistant turn as the result of the call one turn before.

    The tool goes by the length of the text.  Some limits are texts instead of numbers, ``note`` gets a limit that it does
    not know, and calls refer to the one two turns before, through the whole conversation.  A turn without text has no tool, and
    its query and limit are null.
    """
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    n = F.length("text")
    json = lambda value: F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    limit = F.when(n % 11 == 0, json(n.cast("string"))).otherwise(json(n))
    refer = F.when(F.col("turn") > 1, F.to_json(F.struct(name(F.col("turn") - 2).alias("$ref"))))
    arguments = F.concat(F.lit('{"query": '), F.regexp_extract(json(F.col("text")), r"^\{.v.:(.*)\}$", 1),
                         F.lit(', "limit": '), F.regexp_extract(limit, r"^\{.v.:(.*)\}$", 1),
                         F.coalesce(F.concat(F.lit(', "after": '), refer), F.lit("")), F.lit("}"))
    # element_at over literals does not pass on a null place
    tool = F.when(n.isNotNull(), F.element_at(F.array(F.lit("search"), F.lit("fetch"), F.lit("note")), (n % 3 + 1).cast("int")))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    linked = tool_calls.link_tool_calls(calls, results, SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


def _joined(spans, keep=None):
    """kind:start:end of the spans, comma-joined."""
    chosen = spans if keep is None else F.filter(spans, keep)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str, base_only: bool = False):
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & (s["base"] if base_only else F.lit(True)))).cast("long")


@_query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = pii.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count("found", k, base_only=True).alias(f"n_{k}") for k in pii.KINDS]
    n_base = F.size(F.filter("found", lambda s: s["base"])).cast("long")
    return found.select("doc_id", *counts, F.sha2(_joined("found", lambda s: s["base"]), 256).alias("base_sha256"), _joined("found").alias("spans"),
                        n_base.alias("n_base"), (F.size("found") - n_base).alias("n_added"))


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; the models are trained on the same documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    counts = [_count("spans", k).alias(f"n_{k}") for k in secrets.KINDS]
    base = F.sha2(_joined("spans", lambda s: s["kind"] != "markov"), 256)
    n_base = F.size(F.filter("spans", lambda s: s["kind"] != "markov")).cast("long")
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined("spans").alias("spans"), n_base.alias("n_base"),
                        (F.size("spans") - n_base).alias("n_added"))


@_query
def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.fair_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document among 24 shards."""
    return sharding.shard_rows(_read(spark, sf_dir, "documents")).drop("text_key")


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as flat files, and read back."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), path, end_id=1)
    return token_files.read_token_files(manifest, token_files.id_width(path, 1))


@_query
def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors of one label."""
    return embedding_dup.embedding_duplicates(_read(spark, sf_dir, "embeddings"))


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the word use of each source is from the others and from its language."""
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


@_query
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders."""
    return interactions.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


# Fixed values of the oracles: word patterns, window lengths, weights and the generator of the jump hash, as the contracts state.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
       FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hit), unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op7_fair_mix"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
sw AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
lv AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                 / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM sw),
t AS (SELECT *, least(CAST(cap AS DOUBLE), weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM lv),
r AS (SELECT d.doc_id, d.size, d.key, t.source_size, t.target, t.place, t.weight,
             sum(d.size) OVER (PARTITION BY t.place ORDER BY d.key, d.doc_id) AS reached FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (reached + e * source_size) * (10 // weight) AS finish FROM r, (VALUES (0), (1), (2)) AS v(e)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, place) AS used, sum(size) OVER () // 3 AS budget FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN used <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target, key
"""

ORACLES["op9_near_duplicates"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS shingle
      FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, g.b FROM reach r JOIN g ON r.other = g.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op11_embedding_duplicates"] = """
WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, label, e FROM r WHERE label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM r UNION SELECT x.vec_id, l.b FROM reach x JOIN l ON x.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source FROM d GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS p
      FROM dense JOIN v USING (lang)),
ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS HUGEINT) AS q FROM ln JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op13_filter_interactions"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
x AS (SELECT doc_id, part, len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
             100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
             coalesce(doc_id > first_id, false) AS fe FROM w),
y AS (SELECT x.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM x LEFT JOIN (
        SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
        FROM labels GROUP BY doc_id) USING (doc_id)),
m AS (SELECT part, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END,
                          CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM y GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(l)
              WHERE length(o) < 5 AND NOT contains(o, l)),
grid AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, CAST(s AS INTEGER), 1) AS f, substr(o, 1, CAST(s AS INTEGER) - 1) AS earlier
         FROM orders, range(1, 6) AS t(s) WHERE length(o) = 5),
z AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS now,
             length(translate(earlier, fails, '')) < length(earlier) AS gone FROM grid, m),
a AS (SELECT part, filter_order, step, f,
             CAST(sum(CASE WHEN NOT now AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN now AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN now AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN now AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN now AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""
