"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@register
def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix

    plan = mix(read(spark, folder, "documents"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return plan.withColumn("_row", each).select(
        "doc_id", "source", "size", "source_size", "target", "copies", taken
    )


@register
def op3_shard(spark: SparkSession, folder: str) -> DataFrame:
    from .sharding import shard

    cut = shard(read(spark, folder, "documents"), 8, carry=["doc_id"])
    return cut.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, folder, "documents")
    return encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], ids=False)


@register
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    from ..session import scratch_path
    from .warc import read_archive, write_archive

    path = scratch_path(spark, "warc")
    write_archive(read(spark, folder, "pages"), path)
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN strlen(p.h) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.h) >= 1000 AND page_id < top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""


@register
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from .minhash import near_duplicates

    found = near_duplicates(
        read(spark, folder, "documents"), words=3, percent=85, bands=28, rows=6
    )
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE_SQL["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3
    THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b USING (sh)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * inter >= 85 * (a.n + b.n - inter)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.id FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.id) AS component_id,
  d.doc_id = min(r.id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n
"""

#: Key of the registered queries; a real run passes one of its own.
SECRET = "stratiform-test-key"


@register
def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    from .pii import pseudonymise

    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs, SECRET)


@register
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read(spark, folder, "documents")
    model = fit(docs, read(spark, folder, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")


@register
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    from .brown import score

    return score(read(spark, folder, "documents"))


@register
def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from .vector_duplicates import near_vectors

    return near_vectors(read(spark, folder, "embeddings"))


ORACLE_SQL["op10_near_vectors"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, id) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.y, r.id FROM reach r JOIN links l ON l.x = r.vec_id),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.id) AS component_id,
  e.vec_id = min(r.id) AS kept
FROM e JOIN reach r USING (vec_id) LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id
"""


@register
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(read(spark, folder, "embeddings"))


@register
def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from .manifest import build, fold, hexed, leaf_digest, proof_digest, prove

    values = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, folder, "documents")
    told = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(told, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = leaf_digest(*(changed if v == "n_chars" else F.col(v) for v in values))
    proofs = prove(build(docs.withColumn("claim", claim), values, keep=["doc_id", "claim"]))
    folded = proofs.withColumn("folded", fold(F.col("claim")))
    return folded.select(
        "doc_id",
        *(hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        proof_digest(F.col("path")).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


ORACLE_SQL["op11_manifest"] = """
WITH RECURSIVE told AS (SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (SELECT doc_id, lang, n_chars, head, tail,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM told),
up AS (SELECT lang, 0 AS h, r AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM up WHERE n > 1 GROUP BY lang, h, i // 2),
tops AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM up WHERE n = 1),
top AS (SELECT 0 AS h, r AS i, d, count(*) OVER () AS n FROM tops
  UNION ALL SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM top WHERE n > 1 GROUP BY h, i // 2),
crc AS (SELECT range AS b, list_reduce([range] || range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256)),
crcs AS (SELECT doc_id, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, pos + 1, xor(crcs.c // 256, crc.c) FROM crcs JOIN crc
    ON crc.b = xor(crcs.c % 256, ascii(substr(CAST(doc_id AS VARCHAR), pos + 1, 1)))
  WHERE pos < strlen(CAST(doc_id AS VARCHAR))),
hit AS (SELECT doc_id FROM crcs WHERE pos = strlen(CAST(doc_id AS VARCHAR)) AND xor(c, 4294967295) % 7 = 0),
path AS (SELECT doc_id, 0 AS tree, u.h, u.d, l.r >> u.h AS own FROM leaves l JOIN up u
    ON u.lang IS NOT DISTINCT FROM l.lang AND u.i = xor(l.r >> u.h, 1)
  UNION ALL SELECT doc_id, 1, t.h, t.d, s.r >> t.h FROM leaves l JOIN tops s
    ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.i = xor(s.r >> t.h, 1)),
steps AS (SELECT doc_id, u.h AS h, 0 AS tree FROM leaves l JOIN up u
    ON u.lang IS NOT DISTINCT FROM l.lang AND u.i = l.r >> u.h WHERE u.n > 1
  UNION ALL SELECT doc_id, t.h, 1 FROM leaves l JOIN tops s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN top t ON t.i = s.r >> t.h WHERE t.n > 1),
line AS (SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.tree, s.h) AS k, p.d, p.own
  FROM steps s LEFT JOIN path p USING (doc_id, tree, h)),
fold AS (SELECT doc_id, 1 AS k, sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS d
  FROM (SELECT l.*, l.n_chars + CASE WHEN hit.doc_id IS NULL THEN 0 ELSE 1 END AS m
    FROM leaves l LEFT JOIN hit USING (doc_id))
  UNION ALL SELECT f.doc_id, f.k + 1,
    sha256(CASE WHEN l.d IS NULL THEN f.d WHEN l.own % 2 = 1 THEN l.d || f.d ELSE f.d || l.d END)
  FROM fold f JOIN line l ON l.doc_id = f.doc_id AND l.k = f.k),
proof AS (SELECT doc_id, string_agg(d, '' ORDER BY tree, h) AS p FROM path GROUP BY 1)
SELECT l.doc_id, l.leaf, s.d AS subroot, t.d AS root, sha256(coalesce(p.p, '')) AS proof_sha256,
  max_by(f.d, f.k) AS folded_root, max_by(f.d, f.k) = t.d AS verified
FROM leaves l JOIN tops s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n = 1
JOIN fold f ON f.doc_id = l.doc_id LEFT JOIN proof p ON p.doc_id = l.doc_id
GROUP BY l.doc_id, l.leaf, s.d, t.d, p.p
"""


#: A conversation whose texts hold control strings.
PLANTED = r"\### Assistant: </turn> ok"


@register
def op12_chat(spark: SparkSession, folder: str) -> DataFrame:
    from .chat import format_chats, read_loss, read_turns

    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    two = [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    chats = format_chats(turns.union(spark.createDataFrame(two, turns.schema)))
    turns_of = read_turns(F.col("formatted"))
    lines = F.transform(turns_of, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "")
    back = chats.select(
        "conv_id", lines.alias("lines"), loss.alias("loss"), F.length("formatted").alias("chars")
    )
    return back.select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op12_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joined,
    replace(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</part>', '<\/part>'),
      '</turn>', '<\/turn>') AS escaped,
    replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C') AS name
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
l AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS loss FROM t
  WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(length(any_value(loss)), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(any_value(loss), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN joined THEN length('</part>')
    ELSE length(name) + length('### : </turn>') + 1 END) AS BIGINT) AS formatted_chars
FROM e LEFT JOIN l USING (conv_id) GROUP BY conv_id
"""


@register
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .alignment import aligned

    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return aligned(read(spark, folder, "documents"), *files, keep=["doc_id"])
