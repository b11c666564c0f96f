"""Registered queries of this subpackage, with production parameters over whole tables, and the SQL they are checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseal.llm import chat, jaccard, mining, mixing, nearest, packing, private, repeats, sharding, suffix_tree, toxicity, variants, winnow
from fleetseal.llm.common import table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a function of (spark, directory) under its own name."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if check is not None:
            CHECKS[build.__name__] = check
        return build
    return register


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


@query()
def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the suffix tree and under single words."""
    docs = table(spark, sf_dir, "documents")
    scored = suffix_tree.score(docs, ~is_held_out())
    return scored.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of an edited copy, and how alike they are."""
    docs = winnow.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = winnow.fingerprint(docs.withColumn("edited", winnow.edited(F.col("text"), F.col("next_text"))), "edited", "edited_chosen")
    digest = lambda c: F.sha2(F.concat_ws(",", F.col(c).cast("array<string>")), 256)
    return both.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest("chosen").alias("fingerprint"), digest("edited_chosen").alias("edited_fingerprint"),
        winnow.likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        winnow.likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"), F.size("chosen").alias("n_chosen"))


@query(r"""
WITH turns AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role IS NOT NULL AND role <> 'system'),
told AS (SELECT t.conv_id, s.speaker, t.turn, t.role, coalesce(t.role = s.speaker, false) AS trained, t.body,
  '<|turn|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role IS NULL THEN 'user' WHEN t.role = 'system' THEN 'system'
    ELSE 'user ' || t.role END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
cut AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM told),
placed AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, segment
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cut)
SELECT conv_id, speaker, turn, role, segment, CAST(before AS BIGINT) AS start, CAST(length(segment) AS BIGINT) AS length,
  CAST(before + length(head) AS BIGINT) AS body_start, CAST(length(body) + 7 AS BIGINT) AS body_length, trained FROM placed""")
def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the place of each of its speakers."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query(r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
often AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_n, count(*) AS c FROM cells a JOIN cells b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM often WHERE 100 * c >= 75 * (both_n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN reach r ON s.doc_id = r.a""")
def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates that every document is in."""
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query(r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, (place % 3 - 1) * 0.5 AS tilt, 3.0::DOUBLE * source_size AS ceiling FROM per),
ordered AS (SELECT *, row_number() OVER (ORDER BY ceiling / weight, source NULLS FIRST) AS k FROM weighed),
level AS (SELECT *, sum(source_size) OVER () AS total,
  sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM ordered),
filled AS (SELECT *, ceiling * open <= rest * weight AS isfull FROM level),
aims AS (SELECT *, CASE WHEN isfull THEN ceiling ELSE (total - sum(CASE WHEN isfull THEN ceiling ELSE 0 END) OVER ())
  / (sum(weight) OVER () - sum(CASE WHEN isfull THEN weight ELSE 0 END) OVER ()) * weight END AS target FROM filled),
placed AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.tilt, a.weight,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 15), d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS w FROM placed),
counted AS (SELECT *, CAST(w + CASE WHEN before + size / 2.0::DOUBLE <= target - w * source_size AND w < 3 THEN 1 ELSE 0 END AS INTEGER) AS passes FROM whole),
due AS (SELECT *, CASE WHEN target > 0 THEN least((before + size / 2.0::DOUBLE) / target, 1) ELSE 0 END * weight AS wanted FROM counted)
SELECT doc_id, size, source_size, target, size * passes AS taken, passes,
  CASE WHEN passes > 0 THEN round(least(2 * wanted / (weight * (1 - tilt) + sqrt(greatest(weight * (1 - tilt) * weight * (1 - tilt) + 4 * tilt * weight * wanted, 0))), 1), 6) END AS first_position
FROM due""")
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and when it comes first: the mix in training order, each document at its first pass."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(sized, mixing.cyclic_schedules(docs), F.col("words"))
    first = mixing.in_training_order(mixed, untaken=True).filter("coalesce(pass, 0) = 0")
    return first.select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 6).alias("first_position"))


@query()
def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")), 3)
    return toxicity.grade(docs.select("doc_id", "text"), model).select("doc_id", "severity", "toxic_probability", "toxic")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op7_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY, RANKS))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op8_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: how many plain identifiers, and the spans of plain and disguised ones."""
    found = private.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in private.KINDS], F.sha2(private.written(plain), 256).alias("base_sha256"),
                        private.written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(plain)).cast("long").alias("n_disguised"))


@query("""
WITH ok AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20""")
def op9_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 20)


@query()
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier document, or an earlier place, has in a run of several."""
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "removed", "text")


@query("""
WITH ok AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS own, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ok a JOIN ok r ON a.id % 100 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM pairs WHERE own) WHERE place <= 5),
inside AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that lie a little below each positive of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", label.alias("label"))
    return mining.mine(rows.filter(F.col("vec_id") % 100 == 0), rows)


# Unsigned crc32 of the list of bytes "bytes" in SQL: a table of 256 remainders made by its rule, then one step per byte.
_CRC_TABLE = """bits AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""
_CRC = "xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"


_SHARDS = 40


def _sql_tree(tree) -> str:
    """The tree as rows (region, rack, number, weight)."""
    return ", ".join(f"('{s.region}', '{s.rack}', {s.number}, {float(s.weight)}::DOUBLE)" for s in tree)


def _sql_descent(name: str, tree) -> str:
    """Node of every distinct id after each level: at each the child of smallest draw."""
    def level(i: int, node: str, parent: str) -> str:
        return f"""{name}{i} AS (SELECT k.key, arg_min(c.child, -ln((('0x' || substr(md5('shard|' || c.child || '|' || k.key), 1, 13))::BIGINT + 0.5) / 4503599627370496) / c.weight) AS node
  FROM {name}{i - 1} k JOIN (SELECT {parent} AS parent, {node} AS child, sum(weight) AS weight FROM (VALUES {_sql_tree(tree)}) v(region, rack, number, weight) GROUP BY ALL) c
  ON c.parent = k.node GROUP BY k.key)"""
    return ",\n".join([f"{name}0 AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, '' AS node FROM documents)",
                       level(1, "region", "''"), level(2, "region || '/' || rack", "region"),
                       level(3, "region || '/' || rack || '/' || number", "region || '/' || rack")])


@query(f"""
WITH RECURSIVE {_CRC_TABLE},
{_sql_descent("now", sharding.uniform_tree(_SHARDS))},
{_sql_descent("then", sharding.grown(sharding.uniform_tree(_SHARDS)))},
listed AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, {_bytes("coalesce(text, '')")} AS bytes FROM documents),
summed AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM listed, remainders),
parted AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 4096 * 4096 AS part FROM summed),
placed AS (SELECT p.*, CAST(split_part(n.node, '/', 3) AS INTEGER) AS shard, CAST(split_part(t.node, '/', 3) AS INTEGER) AS grown_shard
  FROM parted p JOIN now3 n ON n.key = coalesce(CAST(doc_id AS VARCHAR), 'null') JOIN then3 t ON t.key = n.key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY
  substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32, part)), 1, 3), doc_id NULLS FIRST, size, text_crc32, part) - 1 AS BIGINT) AS slot,
  grown_shard FROM placed""")
def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, its place there, and its shard once there is one more."""
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), sharding.uniform_tree(_SHARDS))
    return sharding.manifest(placed).withColumn("law", F.lit("key"))


@query(f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
listed AS (SELECT doc_id, run, count(*) AS many, {_bytes("doc_id || ':' || run")} AS bytes FROM found GROUP BY doc_id, run),
summed AS (SELECT run, many, CASE WHEN bytes IS NOT NULL THEN {_CRC} END AS h FROM listed, remainders),
kept AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, many FROM summed),
words AS (SELECT word, CAST(sum(many) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(many) >= 5),
places AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words),
skips AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM places WHERE i < length(word)),
gaps AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 1) AS s FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN gaps b ON a.p = b.p AND a.s = b.s
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN gaps b ON a.p = b.p AND a.s = b.s),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
named AS (SELECT b.word, b.n_near, b.best_n, min(n.other) AS best FROM best b JOIN near n ON n.word = b.word AND n.other_n = b.best_n GROUP BY ALL),
judged AS (SELECT w.word, w.n, CASE WHEN m.best_n >= 5 * w.n THEN m.best END AS form, CASE WHEN m.best_n >= 5 * w.n THEN m.best_n END AS form_n, coalesce(m.n_near, 0) AS n_near
  FROM words w LEFT JOIN named m ON w.word = m.word),
ways AS (SELECT word, word AS at FROM judged UNION ALL SELECT w.word, j.form FROM ways w JOIN judged j ON j.word = w.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, w.at AS root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM judged j JOIN ways w ON w.word = j.word JOIN judged e ON e.word = w.at AND e.form IS NULL""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the commoner word that it is a variant of."""
    return variants.group(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
