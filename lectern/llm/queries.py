"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .collocations import collocations
from .filter_audit import audit
from .fingerprints import LEAF_CHARS, fingerprints
from .media import describe, store
from .mix import mix
from .near_dup import near_duplicates
from .passages import repeated_passages
from .pieces import encode_decode
from .quality import fit_model, grade_documents
from .secrets import scan_documents
from .token_counts import prefix_table, token_counts
from .token_files import read_token_files, write_token_files
from .top_k import integer_vectors, top_k


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"), keep=False)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents")))


def op6_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, fit_model(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path, keep=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(prefix_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), limit=1024)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mix": op2_source_mix,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_top_k": op4_top_k,
    "op5_media": op5_media,
    "op6_piece_coding": op6_piece_coding,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
}
# SQL of the queries that SQL can express on whole tables; the others are tested against brute force.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
_VECTORS = "(SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(embedding) > 0)"
ORACLE_SQL: dict[str, str] = {
    "op4_top_k": f"""SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank FROM {_VECTORS} q JOIN {_VECTORS} c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
    "op7_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS h FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
  k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
  e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
  r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.o = e.x)
  SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.o AS component_id, m.o = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(o) AS o FROM r GROUP BY d) m ON m.d = d.doc_id""",
    "op11_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  f AS (SELECT d.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
  g AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
  k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT k.x || l.x || m.x || p.x || q.x AS filter_order FROM k, k l, k m, k p, k q WHERE k.x NOT IN (l.x, m.x, p.x, q.x) AND l.x NOT IN (m.x, p.x, q.x) AND m.x NOT IN (p.x, q.x) AND p.x <> q.x),
  s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS place, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
  r AS (SELECT part, filter_order, step, place, n, good, toxic, fails[place] AS fails, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM g, s),
  t AS (SELECT part, filter_order, step, place, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, place))::BIGINT AS shapley FROM t""",
    "op12_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
  g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
  f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
  k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
  s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (2000000::HUGEINT * k.a // (l.f + r.f))::BIGINT AS score FROM k
    JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
  b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda x: list_transform(range(1, m - x + 2), lambda y: array_to_string(w[y:y + x - 1], ' '))))) AS phrase FROM c WHERE m > 2),
  o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN o USING (lang, phrase)
    WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a QUALIFY rank <= 2000""",
    "op13_fingerprints": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT doc_id, text, length(text) // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS following FROM d),
  t AS (SELECT doc_id, text, left(text, length(text) - half) || left(following, half) AS edited, following FROM n),
  v AS (SELECT DISTINCT unnest([text, edited, following]) AS x FROM t),
  l AS (SELECT x, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?,;]{{1,{LEAF_CHARS}}}[.!?,;]*|[.!?,;]+'), lambda y: md5(y) || ':' || length(y)))) AS leaves FROM v),
  p AS (SELECT x, list_transform(leaves, lambda s: list_transform(s, lambda q: md5(coalesce(array_to_string(q, ','), '')))) AS paragraphs, list_distinct(flatten(flatten(leaves))) AS own FROM l),
  m AS (SELECT x, paragraphs, list_transform(paragraphs, lambda s: md5(array_to_string(s, ','))) AS sections, own, coalesce(list_sum(list_transform(own, lambda y: split_part(y, ':', 2)::BIGINT)), 0) AS size FROM p),
  r AS (SELECT x, paragraphs, sections, sha256(array_to_string(sections, ',')) AS root, own, size FROM m),
  j AS (SELECT t.doc_id, t.text, t.edited, a.root AS fingerprint, b.root AS edited_fingerprint,
    CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(a.own, b.own), lambda y: split_part(y, ':', 2)::BIGINT)), 0)::DOUBLE / greatest(a.size + b.size, 1)::DOUBLE END AS near_edited,
    CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(a.own, c.own), lambda y: split_part(y, ':', 2)::BIGINT)), 0)::DOUBLE / greatest(a.size + c.size, 1)::DOUBLE END AS near_next,
    flatten(list_transform(range(1, greatest(len(a.sections), len(b.sections)) + 1), lambda s: list_transform(list_filter(range(1, greatest(coalesce(len(a.paragraphs[s]), 0), coalesce(len(b.paragraphs[s]), 0)) + 1), lambda q: a.paragraphs[s][q] IS DISTINCT FROM b.paragraphs[s][q]), lambda q: s || ':' || q))) AS places
    FROM t JOIN r a ON t.text = a.x JOIN r b ON t.edited = b.x JOIN r c ON t.following = c.x)
  SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, len(places)::BIGINT AS edits, coalesce(places[1], '') AS first_edit FROM j""",
}
