"""Chunking, requirements, mentions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import chunk_uid as uid_of
from ..functions.hashing import row_hash
from ..operators import retrieval as r
from ..operators import text as tx
from ..operators import text_index as ix
from ..operators import vector_cells as vc
from ..operators.merge import upsert
from . import Tables, query
from .inputs import plain

_WS = "[\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]"
# The fold over a document's lines, with the list functions of the other engine.
_FOLDED = f"""
body AS (SELECT doc_id, source, {_strip("text")} AS body FROM documents),
lines AS (SELECT doc_id, source, string_split_regex(body, '{_BREAK}') AS l FROM body WHERE body <> ''),
start AS (SELECT doc_id, source, list_prepend(
    {{'open': []::VARCHAR[], 'n': 0::BIGINT, 'done': []::VARCHAR[]}},
    list_transform(l, lambda x: {{'open': [x], 'n': length(x)::BIGINT + 1, 'done': []::VARCHAR[]}})) AS s FROM lines),
folded AS (SELECT doc_id, source, list_reduce(s, lambda a, e:
    CASE WHEN a.n + e.n >= 800 THEN {{
      'open': list_slice(list_concat(a.open, e.open), len(a.open) + 2 - (len(a.open) + 1) // 5, len(a.open) + 1),
      'n': coalesce(list_sum(list_transform(list_slice(list_concat(a.open, e.open),
        len(a.open) + 2 - (len(a.open) + 1) // 5, len(a.open) + 1), lambda y: length(y) + 1)), 0)::BIGINT,
      'done': list_concat(a.done, list_filter([{_strip("array_to_string(list_concat(a.open, e.open), chr(10))")}], lambda c: c <> ''))}}
    ELSE {{'open': list_concat(a.open, e.open), 'n': a.n + e.n, 'done': a.done}} END) AS f FROM start),
finished AS (SELECT doc_id, source, CASE WHEN len(f.open) > 0 THEN list_concat(f.done,
    list_filter([{_strip("array_to_string(f.open, chr(10))")}], lambda c: c <> '')) ELSE f.done END AS c FROM folded),
chunks AS (SELECT doc_id, source, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_no, unnest(c) AS text FROM finished)
"""


def _chunks(t: Tables) -> DataFrame:
    source = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return tx.chunk(t.documents, source, "text", F.col("source"))


@query(
    f"""WITH {_FOLDED} SELECT md5(concat('doc:', doc_id, ':', chunk_no, ':', substr(text, 1, 50))) AS uid,
  concat('doc:', doc_id) AS source, source AS source_type, chunk_no, text FROM chunks""",
    headline=True,
)
def chunk_documents(t: Tables) -> DataFrame:
    return _chunks(t)


@query(
    """SELECT md5(concat('doc:', CAST(doc_id AS VARCHAR), ':', '0', ':', substr(text, 1, 50))) AS uid, doc_id
FROM documents"""
)
def chunk_uid(t: Tables) -> DataFrame:
    source = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return t.documents.select(uid_of(source, F.lit(0), F.col("text")).alias("uid"), "doc_id")


@query(
    f"""WITH {_FOLDED} SELECT source AS source_type, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM chunks GROUP BY source"""
)
def chunk_index(t: Tables) -> DataFrame:
    """Indexing the same documents twice leaves one entry per chunk."""
    chunks = _chunks(t)
    index = chunks.withColumn("_row_hash", row_hash(chunks.columns))
    twice = upsert(upsert(index.limit(0), index, ["uid"]), index, ["uid"])
    return twice.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")
    )


# Conversations as tickets: user turns are requirement rows, other turns plain lines.
TICKETS = """
SELECT conv_id, turn, CASE role
  WHEN 'user' THEN concat('| REQ-', CAST(turn AS STRING), ' must | ', text, ' |')
  WHEN 'assistant' THEN concat('Notes. REQ-', CAST(turn AS STRING), ': ', text)
  ELSE text END AS body
FROM {conversations}
"""
_ROW = r"\|?\s*(REQ-\d+)[^\|]*\|([^\|]+)\|?"
_LINE = r"(REQ-\d+)[:\s]+([^\n]+)"


@query(
    f"""WITH t AS ({plain(TICKETS)}), h AS (SELECT conv_id, turn,
  CASE WHEN regexp_matches(body, '{_ROW}') THEN regexp_extract_all(body, '{_ROW}', 1)
    ELSE regexp_extract_all(body, '{_LINE}', 1) END AS ids,
  CASE WHEN regexp_matches(body, '{_ROW}') THEN regexp_extract_all(body, '{_ROW}', 2)
    ELSE regexp_extract_all(body, '{_LINE}', 2) END AS texts FROM t),
u AS (SELECT conv_id, turn, CAST(unnest(range(len(ids))) AS INTEGER) AS req_no, unnest(ids) AS i, unnest(texts) AS b FROM h)
SELECT conv_id, turn, req_no, {_strip("i")} AS req_id, {_strip("b")} AS req_text FROM u"""
)
def requirements(t: Tables) -> DataFrame:
    return tx.extract_requirements(t.view(TICKETS), ["conv_id", "turn"], "body")


MENTIONED = ("the", "und", "les", "track", "zz-none")


@query(
    " UNION ALL ".join(
        f"""SELECT doc_id, '{n}' AS name, array_to_string(list_slice(list_filter(
  string_split_regex(text, '{_BREAK}'), lambda x: contains(x, '{n}')), 1, 5), chr(10)) AS lines
FROM documents WHERE contains(text, '{n}')"""
        for n in MENTIONED
    ),
    headline=True,
)
def find_mentions(t: Tables) -> DataFrame:
    return tx.find_mentions(t.documents, ["doc_id"], "text", MENTIONED)


# --- retrieval ------------------------------------------------------------------------------


def _centroids(t: Tables) -> DataFrame:
    """One query vector per label: the mean of its embeddings."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return ordered.select("label", F.transform("v", lambda s: s["x"]).alias("embedding"))


_TOPK = """
cells AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT c.label, e.vec_id, e.label AS item_label,
  round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 9) AS cos FROM c, embeddings e),
topk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS INTEGER) AS rank
  FROM s) WHERE rank <= 10)
"""


@query(
    f"WITH {_TOPK} SELECT label, rank, vec_id, round(greatest(0.0, cos), 3) AS score FROM topk",
    headline=True,
)
def vector_topk(t: Tables) -> DataFrame:
    return r.vector_topk(
        _centroids(t), t.embeddings, 10, query_id="label", item_id="vec_id", vector="embedding"
    )


@query(f"WITH {_TOPK} SELECT label, rank, vec_id, round(greatest(0.0, cos), 3) AS score FROM topk")
def vector_topk_cells(t: Tables) -> DataFrame:
    """From vectors laid out by cells; a query visits those whose bound reaches its k-th score."""
    path = t.scratch("cells")
    vc.create_cells(t.embeddings, path, item_id="vec_id", vector="embedding")
    return vc.search_cells(
        t.spark, path, _centroids(t), 10, query_id="label", item_id="vec_id", vector="embedding"
    ).ranked


@query(
    f"""WITH {_TOPK} SELECT label, rank, vec_id, round(greatest(0.0, cos), 3) AS score FROM (
  SELECT label, vec_id, cos, CAST(row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS INTEGER) AS rank
  FROM s WHERE item_label >= 5) WHERE rank <= 3"""
)
def vector_topk_filtered(t: Tables) -> DataFrame:
    """With a filter on the items, and queries in blocks as if there were very many."""
    items = t.embeddings.withColumnRenamed("label", "item_label")
    return r.vector_topk(
        _centroids(t), items, 3, query_id="label", item_id="vec_id", vector="embedding",
        where=F.col("item_label") >= 5
    )


@query(
    f"""WITH {_TOPK} SELECT label, vec_id, round(greatest(0.0, cos), 3) AS score,
  CASE WHEN round(greatest(0.0, cos), 3) >= 0.3 THEN 'surface' ELSE 'create' END AS action
FROM topk WHERE rank = 1"""
)
def surface_or_create(t: Tables) -> DataFrame:
    required = _centroids(t)
    best = r.vector_topk(
        required, t.embeddings, 1, query_id="label", item_id="vec_id", vector="embedding"
    )
    return r.surface_or_create(required, best, "label", threshold=0.3)


_BM25 = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
terms AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),
tokens AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS t FROM w),
tf AS (SELECT doc_id, n_words, t, count(*) AS tf FROM tokens WHERE t IN (SELECT t FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
scored AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / avg_len))), 12) AS exact
  FROM terms JOIN df USING (t) JOIN tf USING (t), sizes GROUP BY item_id, doc_id),
bm AS (SELECT item_id, doc_id, rank, round(exact, 6) AS score FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, doc_id) AS INTEGER) AS rank
  FROM scored) WHERE rank <= 10)
"""


def _bm25(t: Tables) -> DataFrame:
    return r.bm25(t.documents, t.benchmark, 10, doc_id="doc_id", query_id="item_id", text="text")


@query(f"WITH {_BM25} SELECT item_id, rank, doc_id, score FROM bm", headline=True)
def bm25(t: Tables) -> DataFrame:
    return _bm25(t)


@query(f"WITH {_BM25} SELECT item_id, rank, doc_id, score FROM bm WHERE rank <= 3")
def bm25_joined(t: Tables) -> DataFrame:
    """Fewer results per query."""
    return r.bm25(t.documents, t.benchmark, 3, doc_id="doc_id", query_id="item_id", text="text")


@query(f"WITH {_BM25} SELECT item_id, rank, doc_id, score FROM bm")
def bm25_index(t: Tables) -> DataFrame:
    """From a stored index; most blocks of frequent words stay unread."""
    path = t.scratch("index")
    ix.create_index(t.documents, path, doc_id="doc_id", text="text")
    return ix.search(t.spark, path, t.benchmark, 10, doc_id="doc_id", query_id="item_id", text="text").ranked


@query(f"WITH {_BM25} SELECT item_id, rank, doc_id, score FROM bm WHERE rank <= 5")
def bm25_upserted(t: Tables) -> DataFrame:
    """Every second document is indexed with another text at first, and every third not at all."""
    path, late, wrong = t.scratch("index"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    at_first = F.when(wrong, F.reverse("text")).otherwise(F.col("text"))
    first = t.documents.where(~late).withColumn("text", at_first)
    ix.create_index(first, path, doc_id="doc_id", text="text")
    ix.upsert_documents(t.documents.where(late | wrong), path, doc_id="doc_id", text="text")
    return ix.search(t.spark, path, t.benchmark, 5, doc_id="doc_id", query_id="item_id", text="text").ranked


@query(
    f"""WITH {_BM25}, other AS (SELECT item_id, doc_id,
  CAST(row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id DESC) AS INTEGER) AS rank FROM bm),
fused AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM
  (SELECT item_id, rank, doc_id FROM bm UNION ALL SELECT item_id, rank, doc_id FROM other) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id, score,
  CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused)
WHERE rank <= 5"""
)
def rrf_fusion(t: Tables) -> DataFrame:
    """The BM25 ranking fused with a second opinion on the same documents."""
    first = _bm25(t)
    w = Window.partitionBy("item_id").orderBy(F.asc("score"), F.desc("doc_id"))
    second = first.withColumn("rank", F.row_number().over(w))
    return r.rrf([first, second], "item_id", "doc_id", 5)
