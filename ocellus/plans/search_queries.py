"""Queries of the search side and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.engine import Engine, Settings
from ocellus.functions.lexicon import TERMS, expand_queries
from ocellus.functions.text import author_key, highlight, matches, normalize_query, snippet
from ocellus.operators import fulltext, fusion, retrieval
from ocellus.plans import understanding
from ocellus.sources import export
from ocellus.sources import papers as source
from ocellus.sources.stores import VectorStore
from ocellus.sources.tables import table
from ocellus.storage import shared_folder

WORDS = ["dry", "eye"]
QUERY, PHRASE, HAN, AUTHOR, SURNAME = "dry eye", '"corneal haze" OR kerato*', "白内障", "yan gong", "龚"
MODEL = ("api", "eye-embed-2", 128)


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return source.papers(table(spark, folder, "papers"), table(spark, folder, "paper_keywords"))


PREPARED: dict[tuple[str, str], str] = {}


def prepared(spark: SparkSession, folder: str, **options) -> Engine:
    """An engine over the prepared papers and postings of a folder, which are written once a session into the shared folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in PREPARED:
        path = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
        Engine.prepare(table(spark, folder, "papers"), table(spark, folder, "paper_keywords"), path)
        PREPARED[key] = path
    return Engine.prepared(spark, PREPARED[key], **options)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.token_index(typed(spark, folder))


def round6(x):
    return F.floor(x * 1_000_000 + 0.5) / 1_000_000


def rounded(df: DataFrame) -> DataFrame:
    return df.select("id", round6(F.col("score")).alias("score"))


def q_papers(spark, folder):
    t = typed(spark, folder)
    return t.select("id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), "abstract", "year", "doi", "url", "citation", "journal", "volume", "issue", "pages", "page_start", "page_end")


def q_split_text_list(spark, folder):
    t = source.papers(table(spark, folder, "papers")).select("id", F.posexplode("authors").alias("at", "author"))
    return t.select("id", (F.col("at") + 1).cast("bigint").alias("author_no"), "author")


def q_keyword_merge(spark, folder):
    return typed(spark, folder).select("id", F.posexplode("keywords").alias("at", "keyword")).select("id", (F.col("at") + 1).cast("bigint").alias("keyword_no"), "keyword")


def q_paper_detail(spark, folder):
    return source.paper_detail(typed(spark, folder), 7).select("id", "title", F.array_join("authors", "|").alias("authors"), "year", F.array_join("keywords", "|").alias("keywords"), "abstract", "citation", "doi", "url")


def q_year_filter(spark, folder):
    return typed(spark, folder).filter(fusion.in_years(2015, 2020)).select("id", "year")


def q_author_include(spark, folder):
    return typed(spark, folder).filter(retrieval.names_any(["Yan Gong", "龚颜"])).select("id")


def q_author_exclude(spark, folder):
    return typed(spark, folder).filter(~retrieval.names_any(["Yan Gong", "龚颜"])).select("id")


def q_author_normalize(spark, folder):
    return typed(spark, folder).select("id", author_key(F.array_join("authors", " ")).alias("author_key"))


def q_known_author(spark, folder):
    key = author_key(F.array_join("authors", " "))
    return typed(spark, folder).agg(F.coalesce(F.bool_or(key.contains("zhuo")), F.lit(False)).alias("known"))


def q_surname_filter(spark, folder):
    return typed(spark, folder).filter(retrieval.has_surname(SURNAME)).select("id")


def q_word_boundary_match(spark, folder):
    t = typed(spark, folder)
    return t.select("id", matches("abstract", "mm").alias("short_word"), matches("title", "Macular H").alias("part"))


def q_snippet(spark, folder):
    return typed(spark, folder).select("id", snippet("abstract", 180, "...").alias("abstract_snippet"), snippet("citation", 140, "…").alias("citation_snippet"))


def q_highlight(spark, folder):
    return typed(spark, folder).select("id", highlight("title", "Macular hole").alias("marked"))


def q_journal_clean(spark, folder):
    from ocellus.functions.text import clean_journal

    return typed(spark, folder).select("id", clean_journal(F.concat(F.lit("Opt. Soc. "), F.coalesce("journal", F.lit("")), F.lit(" ."))).alias("journal"))


def q_author_clean(spark, folder):
    from ocellus.functions.text import clean_author

    return source.papers(table(spark, folder, "papers")).select("id", F.array_join(F.transform("authors", clean_author), "|").alias("authors"))


def q_ris_export(spark, folder):
    return export.ris(typed(spark, folder))


def q_enw_export(spark, folder):
    return export.enw(typed(spark, folder))


def q_plain_text(spark, folder):
    return export.plain_text(typed(spark, folder))


def q_token_postings(spark, folder):
    return fulltext.postings(index(spark, folder)).select("token", "id", "tf")


def q_document_frequency(spark, folder):
    return fulltext.document_frequency(index(spark, folder))


def q_corpus_stats(spark, folder):
    return fulltext.corpus_stats(index(spark, folder)).select("n", round6(F.col("avgdl")).alias("avgdl"))


def q_bm25_raw(spark, folder):
    return rounded(fulltext.bm25_raw(index(spark, folder), QUERY))


def q_bm25_postings_top100(spark, folder):
    i = index(spark, folder)
    return rounded(fulltext.bm25_of_words(fulltext.postings(i), fulltext.corpus_stats(i), WORDS))


def q_bm25_posted(spark, folder):
    return rounded(prepared(spark, folder).matches(QUERY))


def q_bm25_phrase(spark, folder):
    return rounded(prepared(spark, folder).matches(PHRASE))


def q_bm25_phrase_scan(spark, folder):
    return rounded(fulltext.bm25_raw(index(spark, folder), PHRASE))


def q_bm25_normalized_top100(spark, folder):
    return rounded(prepared(spark, folder).full_text(QUERY))


def q_keyword_tiers(spark, folder):
    return rounded(typed(spark, folder).select("id", retrieval.keyword_score(QUERY).alias("score")).filter("score > 0"))


def q_keyword_tiers_han(spark, folder):
    return rounded(typed(spark, folder).select("id", retrieval.keyword_score(HAN).alias("score")).filter("score > 0"))


def q_lexical_fallback(spark, folder):
    return rounded(retrieval.by_terms(typed(spark, folder), "corneal haze in mice"))


def q_author_tiers(spark, folder):
    return rounded(typed(spark, folder).select("id", retrieval.author_score(AUTHOR).alias("score")).filter("score > 0"))


def q_author_retrieve(spark, folder):
    return rounded(retrieval.by_authors(typed(spark, folder), AUTHOR))


def q_score_map_merge(spark, folder):
    t = typed(spark, folder)
    return rounded(fusion.merge_scores([fulltext.full_text(fulltext.token_index(t), QUERY), retrieval.by_keywords(t, QUERY)]))


def query_vector(spark, folder) -> list[float]:
    return table(spark, folder, "embeddings").filter("vec_id = 0").first()["embedding"]


def q_knn_cosine_top100(spark, folder):
    found = retrieval.nearest_arrays(table(spark, folder, "embeddings"), query_vector(spark, folder), 100, "vec_id", "embedding")
    return found.select("id", round6(F.col("score")).alias("score"))


def q_knn_papers(spark, folder):
    import numpy as np

    usable = table(spark, folder, "paper_embeddings").filter("provider = 'api' and model = 'eye-embed-2' and length(embedding_blob) = 512")
    first = usable.orderBy("paper_id").first()
    q = np.frombuffer(first["embedding_blob"], "<f4").astype(float)
    return retrieval.nearest_blobs(usable.select("paper_id", F.col("embedding_blob").alias("blob")), (q / max(np.linalg.norm(q), 1e-30)).tolist())


def q_knn_blobs(spark, folder):
    """Vectors in blobs, as the fresh ones of the search are."""
    vector = np.asarray(query_vector(spark, folder), np.float64)
    fresh = source.fresh_embeddings(stored_vectors(spark, folder), typed(spark, folder), "api", VECTORS.model, VECTORS.dimensions)
    return rounded(retrieval.nearest_blobs(fresh, (vector / np.sqrt(vector @ vector)).tolist()))


def q_embedding_text_hash(spark, folder):
    return typed(spark, folder).select("id", source.text_hash().alias("text_hash"))


def q_embedding_freshness(spark, folder):
    return source.freshness(table(spark, folder, "paper_embeddings"), typed(spark, folder), *MODEL)


def q_embedding_fresh_rows(spark, folder):
    return source.fresh_embeddings(table(spark, folder, "paper_embeddings"), typed(spark, folder), *MODEL).select("paper_id")


def q_embedding_pending(spark, folder):
    return source.pending_embeddings(table(spark, folder, "paper_embeddings"), typed(spark, folder), *MODEL).select("paper_id", "text_hash")


def q_embedding_upsert(spark, folder):
    e = table(spark, folder, "paper_embeddings")
    new = e.filter("model = 'eye-embed-2'").withColumn("text_hash", F.lit("0" * 64)).withColumn("embedding_blob", F.lit(None).cast("binary"))
    return source.upsert_embeddings(e, new).select("paper_id", "provider", "model", "dimensions", "text_hash")


def q_embedding_store(spark, folder):
    """The same upsert through stored vectors, written to the shared folder and read again."""
    e = table(spark, folder, "paper_embeddings")
    store = VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", 16)
    store.upsert(e)
    store.upsert(e.filter("model = 'eye-embed-2'").withColumn("text_hash", F.lit("0" * 64)).withColumn("embedding_blob", F.lit(None).cast("binary")))
    return store.read().select("paper_id", "provider", "model", "dimensions", "text_hash")


def q_recency_score(spark, folder):
    t = typed(spark, folder)
    return t.crossJoin(F.broadcast(fusion.year_bounds(t))).select("id", round6(fusion.recency()).alias("recency_score"))


def q_lexicon_expansion_join(spark, folder):
    e = table(spark, folder, "analytics_events").filter("event_type = 'search'").select(normalize_query("query_raw").alias("query")).distinct()
    return expand_queries(e, "query").select("query", "term", "expansion")


def fused(spark, folder, sort: str, limit: int | None = None) -> DataFrame:
    return fusion.ordered(prepared(spark, folder).ranked(QUERY)[1], sort, limit)


SHOWN = ("id", "final_score", "fts_score", "semantic_score", "author_score", "recency_score", "year")


def all_shown(scored: DataFrame) -> DataFrame:
    return scored.select(*SHOWN, "hits", F.array_join("sources", ",").alias("sources"))


def q_rank_fusion_best_match(spark, folder):
    return fused(spark, folder, "best_match", 50).select(*SHOWN)


def q_rank_fusion_most_recent(spark, folder):
    return fused(spark, folder, "most_recent", 20).select(*SHOWN)


def q_rank_fusion_candidates(spark, folder):
    return all_shown(prepared(spark, folder).ranked(QUERY)[1])


def q_rank_fusion_scan(spark, folder):
    """The same without anything prepared."""
    return all_shown(Engine.over(spark, folder, keep=False).ranked(QUERY)[1])


VECTORS = Settings(model="unit", dimensions=64)


def stored_vectors(spark, folder) -> DataFrame:
    """The table of embeddings as vectors of the papers with their numbers, fresh ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.asarray(v, "<f4").tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), pa.array(blobs, pa.binary())], names=["paper_id", "embedding_blob"])

    blobs = table(spark, folder, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding").mapInArrow(pack, "paper_id bigint, embedding_blob binary")
    now = typed(spark, folder).select(F.col("id").alias("paper_id"), source.text_hash().alias("text_hash"))
    return blobs.join(now, "paper_id").select("paper_id", F.lit("api").alias("provider"), F.lit("unit").alias("model"), F.lit(64).alias("dimensions"), "text_hash", "embedding_blob")


def q_fusion_vector_years(spark, folder):
    """Full text, rewrites and vectors, within years."""
    engine = prepared(spark, folder, embeddings=stored_vectors(spark, folder), settings=VECTORS)
    return all_shown(engine.ranked(QUERY, 2010, 2020, vector=query_vector(spark, folder))[1])


def q_fusion_author_included(spark, folder):
    """An author who is searched for and filtered by, whether the corpus has them or not."""
    engine = prepared(spark, folder)
    forms = understanding.rewrites(QUERY, None)[: understanding.rewrite_limit(QUERY)]
    found = {"raw": engine.raw_recall(QUERY), "rewrite": engine.rewrite_recall(forms), "author": retrieval.by_authors(engine.papers, AUTHOR)}
    return all_shown(fusion.fuse(engine.papers, found, QUERY, include=["Yan Gong"]))


def q_fusion_author_excluded(spark, folder):
    """A Chinese question that leaves an author out."""
    return all_shown(prepared(spark, folder).ranked("不要龚颜作者的白内障研究")[1])


def q_fusion_mixed_script(spark, folder):
    """Chinese and English words, and years told by words."""
    return all_shown(prepared(spark, folder).ranked("近十年 OCT 白内障", today=date(2024, 6, 1))[1])


def q_llm_blend(spark, folder):
    scored = prepared(spark, folder).ranked(QUERY)[1]
    judged = fusion.ordered(scored, limit=10).select("id", (F.pmod("id", F.lit(7)) / 7.0).alias("judge_score"))
    return fusion.blend(scored, judged).select("id", "final_score", "judge_score")


def q_search_han(spark, folder):
    """A Chinese question with years and an author, through the whole pipeline; its plan depends on what is found, so SQL has no twin."""
    return prepared(spark, folder).search("近五年白内障手术的文章", 20, today=date(2024, 6, 1)).select(*SHOWN)


# --- SQL


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def items(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[;,\n\r]+'), lambda i: {strip('i')}), lambda i: i <> '')"


def text(x: str) -> str:
    return f"nullif({strip(x)}, '')"


PAPERS = f"""kw AS (SELECT paper_id, list(keyword ORDER BY coalesce(keyword_order, -1), keyword) AS more
  FROM (SELECT paper_id, {strip('keyword')} AS keyword, keyword_order FROM paper_keywords) WHERE keyword <> '' GROUP BY paper_id),
own AS (SELECT papers.paper_id AS id, coalesce(title, '') AS title, {items('authors_display')} AS authors, {items('keywords_text')} AS given, coalesce(abstract_text, '') AS abstract,
  publication_year AS year, {text('doi')} AS doi, {text('url')} AS url, {text('citation_text')} AS citation, {text('journal')} AS journal, {text('volume')} AS volume, {text('issue')} AS issue,
  {text('pages')} AS pages, {text('page_start')} AS page_start, {text('page_end')} AS page_end, coalesce(more, []) AS more FROM papers LEFT JOIN kw ON kw.paper_id = papers.paper_id),
p AS (SELECT * EXCLUDE (given, more), list_concat(given, list_filter(more, lambda x, i: list_position(more, x) = i AND NOT list_contains(given, x))) AS keywords FROM own)"""


def with_papers(rest: str) -> str:
    return f"WITH {PAPERS} {rest}"


def tok(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"


TOKENS = f"t AS (SELECT id, {tok('title')} AS title, {tok("array_to_string(authors, ' ')")} AS authors, {tok("array_to_string(keywords, ' ')")} AS keywords, {tok('abstract')} AS abstract FROM p), a AS (SELECT id, list_concat(title, authors, keywords, abstract) AS toks, len(title) + len(authors) + len(keywords) + len(abstract) AS length FROM t)"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def bm25(words: list[str], name: str, both: str = "AND") -> str:
    """Tables ending in <name>(id, score): papers with all (or any) of the words; needs a."""
    counts = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}'))::DOUBLE AS f{i}" for i, w in enumerate(words))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS d{i}" for i in range(len(words)))
    part = " + ".join(f"greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * (f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)))" for i in range(len(words)))
    match = f" {both} ".join(f"f{i} > 0" for i in range(len(words)))
    return f"{name}_f AS (SELECT id, length, {counts} FROM a), {name}_s AS (SELECT count(*)::DOUBLE AS n, sum(length) / count(*)::DOUBLE AS avgdl, {dfs} FROM {name}_f), {name} AS (SELECT id, {part} AS score FROM {name}_f, {name}_s WHERE {match})"


def spread(name: str, out: str, topn: int = 100) -> str:
    return f"{out}_t AS (SELECT id, score FROM {name} ORDER BY score DESC, id LIMIT {topn}), {out} AS (SELECT id, CASE WHEN (SELECT max(score) = min(score) FROM {out}_t) THEN 1.0::DOUBLE ELSE (score - (SELECT min(score) FROM {out}_t)) / (SELECT max(score) - min(score) FROM {out}_t) END AS score FROM {out}_t)"


KEYS = f"k AS (SELECT id, list_filter(list_transform(keywords, lambda x: lower({strip('x')})), lambda x: x <> '') AS w FROM p)"


def holds(x: str, word: str) -> str:
    """A word of one to four Latin letters stands by itself, others may be part of a word."""
    short = word.isascii() and word.isalpha() and len(word) <= 4
    return f"regexp_matches({x}, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')" if short else f"contains({x}, '{word}')"


def kw_two(a: str, b: str, name: str = "keyed") -> str:
    j = "array_to_string(w, ' ')"
    both = f"{a} {b}"
    one = lambda x: f"CASE WHEN {holds(j, x)} THEN 1 ELSE 0 END"
    return f"{name} AS (SELECT id, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE WHEN list_contains(w, '{both}') THEN 1.0::DOUBLE WHEN contains({j}, '{both}') THEN 0.9::DOUBLE ELSE 0.35::DOUBLE * (({one(a)} + {one(b)}) / 2.0::DOUBLE) END AS score FROM k)"


NORM = r"regexp_replace(lower(array_to_string(authors, ' ')), '[\s\p{Z},，。.;；:：()（）#''\"-]+', '', 'g')"
ANY_AUTHOR = f"(contains(lower(array_to_string(authors, ' ')), 'yan gong') OR contains({NORM}, 'yangong') OR contains(lower(array_to_string(authors, ' ')), '龚颜') OR contains({NORM}, '龚颜'))"
EMBED = f"array_to_string(list_filter([{strip('title')}, {strip("concat('Keywords: ', array_to_string(keywords, ', '))")}, {strip('abstract')}], lambda x: x <> ''), chr(10))"
STORED = "paper_embeddings WHERE provider = 'api' AND model = 'eye-embed-2' AND dimensions = 128"


def clean_author(x: str) -> str:
    return f"trim({collapse(f"replace({x}, '#', '')")}, ' ,;')"


def clean_journal(x: str) -> str:
    raw = f"trim({collapse(x)}, ' .')"
    parts = f"list_filter(list_transform(string_split({raw}, '.'), lambda i: trim(i)), lambda i: i <> '')"
    return f"CASE WHEN len({parts}) >= 2 THEN {parts}[-1] ELSE {raw} END"


def tag(t: str, x: str) -> str:
    return f"'{t}' || nullif(CAST({x} AS VARCHAR), '')"


AUTHOR_LINES = lambda t: f"list_transform(list_filter(list_transform(authors, lambda a: {clean_author('a')}), lambda a: a <> ''), lambda a: '{t}' || a)"
J = clean_journal("coalesce(journal, '')")
CRLF = "chr(13) || chr(10)"
RIS = f"""SELECT id, array_to_string(list_filter(list_concat(['TY  - JOUR', 'TI  - ' || title], {AUTHOR_LINES('AU  - ')}, [{tag('JO  - ', J)}, {tag('T2  - ', J)}, {tag('PY  - ', 'nullif(year, 0)')}, {tag('VL  - ', 'volume')}, {tag('IS  - ', 'issue')},
 {tag('SP  - ', 'page_start')}, CASE WHEN page_end IS NOT NULL THEN 'EP  - ' || page_end ELSE 'SP  - ' || pages END, {tag('DO  - ', 'doi')}, {tag('UR  - ', 'url')}, {tag('AB  - ', 'abstract')}, {tag('N1  - ', 'citation')}, 'ER  -']), lambda x: x IS NOT NULL), {CRLF}) || {CRLF} AS ris FROM p"""
ENW = f"""SELECT id, chr(65279) || array_to_string(list_filter(list_concat(['%0 Journal Article', '%T ' || title, {tag('%B ', J)}, {tag('%D ', 'nullif(year, 0)')}, {tag('%V ', 'volume')}, {tag('%N ', 'issue')},
 '%P ' || coalesce(pages, page_start || '-' || page_end, page_start), {tag('%R ', 'doi')}, {tag('%U ', 'url')}, {tag('%X ', 'abstract')}, {tag('%Z ', collapse('citation'))}], {AUTHOR_LINES('%A ')}), lambda x: x IS NOT NULL), {CRLF}) || {CRLF} || {CRLF} AS enw FROM p"""
PLAIN = """SELECT id, array_to_string(['标题: ' || title, '作者: ' || array_to_string(authors, ', '), '年份: ' || coalesce(CAST(year AS VARCHAR), '-'), '关键词: ' || array_to_string(keywords, ', '), 'DOI: ' || coalesce(doi, '-'),
 '网址: ' || coalesce(url, '-'), '', '摘要:', abstract, '', '引用:', coalesce(citation, '（暂无）')], chr(10)) AS text FROM p"""

BOUNDS = "b AS (SELECT min(year) AS y0, max(year) AS y1 FROM p WHERE year <> 0)"
RECENCY = "CASE WHEN coalesce(year, 0) = 0 OR y0 IS NULL THEN 0.0::DOUBLE WHEN y0 = y1 THEN 1.0::DOUBLE ELSE least(greatest((year - y0) / (y1 - y0)::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END"
HAN_TERMS = ["白内障", "白内", "内障"]
HAN_KEYS = "kh AS (SELECT id, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE WHEN list_contains(w, '白内障') THEN 1.0::DOUBLE WHEN contains(array_to_string(w, ' '), '白内障') THEN 0.9::DOUBLE ELSE greatest(" + ", ".join(f"CASE WHEN list_contains(w, '{t}') THEN 1.0::DOUBLE WHEN len(list_filter(w, lambda x: contains(x, '{t}') OR contains('{t}', x))) > 0 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END" for t in HAN_TERMS) + ") END AS score FROM k)"


def best_hundred(name: str, out: str) -> str:
    return f"{out} AS (SELECT id, score FROM {name} WHERE score > 0 ORDER BY score DESC, id LIMIT 100)"


def greatest_of(parts: list[str], out: str) -> str:
    return f"{out} AS (SELECT id, max(score) AS score FROM ({' UNION ALL '.join(f'SELECT id, score FROM {x}' for x in parts)}) GROUP BY id)"


def recalled(words: list[str], keys: str, rewritten: list[list[str]]) -> str:
    """Tables raw and rew: full text and keywords of a query, which finds something by itself, and full text of its rewritten forms."""
    forms = ", ".join(f"{bm25(w, f'm{i}')}, {spread(f'm{i}', f'w{i}')}" for i, w in enumerate(rewritten))
    return f"{bm25(words, 'm')}, {spread('m', 'fts')}, {KEYS}, {keys}, {best_hundred('keyed', 'kwt')}, {greatest_of(['fts', 'kwt'], 'raw')}, {forms}, {greatest_of([f'w{i}' for i in range(len(rewritten))], 'rew')}"


NOTHING = "AS (SELECT NULL::BIGINT AS id, NULL::DOUBLE AS score WHERE false)"
SEMANTIC = "sem AS (SELECT vec_id AS id, least(greatest((list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(q, q)) + 1) / 2, 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id IN (SELECT id FROM p) ORDER BY score DESC, id LIMIT 100)"


def fused_sql(recall: str, query: str, weights: tuple[float, float], where: str = "true", semantic: str = f"sem {NOTHING}", author: str = f"aut {NOTHING}") -> str:
    """Tables ending in fu: the scores of all candidates that pass `where`."""
    shown = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN '{label}' END" for x, label in (("rs", "raw_fts"), ("ws", "rewrite_fts"), ("ss", "embedding"), ("aus", "author")))
    hits = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END)" for x in ("rs", "ws", "ss", "aus"))
    zero = ", ".join(f"coalesce({x}, 0.0::DOUBLE) AS {x}0" for x in ("rs", "ws", "ss", "aus"))
    final = f"0.55::DOUBLE * ss0 + {weights[0]}::DOUBLE * rs0 + {weights[1]}::DOUBLE * ws0 + 0.60::DOUBLE * aus0 + 0.10::DOUBLE * th + 0.05::DOUBLE * kh + 0.03::DOUBLE * rec + 0.04::DOUBLE * hits / 4.0::DOUBLE"
    return f"""WITH {PAPERS}, {TOKENS}, {recall}, {semantic}, {author}, {BOUNDS},
every AS (SELECT id FROM raw UNION SELECT id FROM rew UNION SELECT id FROM sem UNION SELECT id FROM aut),
c AS (SELECT every.id, raw.score AS rs, rew.score AS ws, sem.score AS ss, aut.score AS aus FROM every LEFT JOIN raw ON raw.id = every.id LEFT JOIN rew ON rew.id = every.id LEFT JOIN sem ON sem.id = every.id LEFT JOIN aut ON aut.id = every.id),
z AS (SELECT p.id, year, {zero}, {hits} AS hits, array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS sources,
  CASE WHEN contains(lower(title), '{query}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS th, CASE WHEN len(list_filter(keywords, lambda x: contains(lower(x), '{query}'))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kh, {RECENCY} AS rec FROM c JOIN p ON p.id = c.id, b WHERE {where}),
fu AS (SELECT id, {r4(final)} AS final_score, {r4('greatest(rs0, ws0)')} AS fts_score, {r4('ss0')} AS semantic_score, {r4('aus0')} AS author_score, {r4('rec')} AS recency_score, year, hits, sources FROM z)
"""


# the two words find something by themselves and are rewritten to the lexicon's 干眼症 and 干眼
DRY_EYE = recalled(WORDS, kw_two(*WORDS), [["干眼症"], ["干眼"]])
FUSED = fused_sql(DRY_EYE, QUERY, (0.24, 0.06))
COLUMNS = "id, final_score, fts_score, semantic_score, author_score, recency_score, year"
ORDER = "final_score DESC, coalesce(year, 0) DESC, id"
LEXICON = ", ".join(f"('{t}', '{x}')" for t, others in TERMS.items() for x in others)

AUTHOR_SCORE = """au AS (SELECT id, lower(array_to_string(authors, ' ')) AS x FROM p), au2 AS (SELECT id, CASE WHEN x = '' THEN 0.0::DOUBLE WHEN contains(x, 'yan gong') THEN 1.0::DOUBLE
 ELSE ((CASE WHEN regexp_matches(x, '(^|[^a-z0-9])yan([^a-z0-9]|$)') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(x, '(^|[^a-z0-9])gong([^a-z0-9]|$)') THEN 1 ELSE 0 END)) / 2.0::DOUBLE END AS score FROM au)"""
LEXICAL = "lx AS (SELECT id, lower(title || ' ' || array_to_string(keywords, ' ') || ' ' || abstract) AS x FROM p), lx2 AS (SELECT id, ((CASE WHEN contains(x, 'corneal') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(x, '(^|[^a-z0-9])haze([^a-z0-9]|$)') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(x, '(^|[^a-z0-9])in([^a-z0-9]|$)') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(x, '(^|[^a-z0-9])mice([^a-z0-9]|$)') THEN 1 ELSE 0 END)) / 4.0::DOUBLE AS score FROM lx)"
# the author part of "不要龚颜作者": 颜 before 作者 is taken for a surname; of the pairs of characters those that are no stop words
ASKED = ["不要龚颜作者", "不要", "要龚", "龚颜", "颜作"]
AUTHOR_HAN = r"""au AS (SELECT id, authors, lower(array_to_string(authors, ' ')) AS x FROM p), au1 AS (SELECT id, x, len(list_filter(authors, lambda a: regexp_matches(a, '\(\s*颜[一-鿿\s]*\)|^\s*颜'))) > 0 AS named, """ + " + ".join(f"(CASE WHEN contains(x, '{t}') THEN 1 ELSE 0 END)" for t in ASKED) + """ AS n FROM au),
 au2 AS (SELECT id, CASE WHEN x = '' THEN 0.0::DOUBLE WHEN contains(x, '不要龚颜作者') THEN 1.0::DOUBLE ELSE greatest(CASE WHEN named THEN 0.92::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN n >= 2 THEN 1.0::DOUBLE WHEN n = 1 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM au1)"""
POSITIONS = """ph AS (SELECT id, length, (""" + " + ".join(f"len(list_filter(range(1, greatest(len({c}), 1)), lambda i: {c}[i] = 'corneal' AND {c}[i + 1] = 'haze'))" for c in ("title", "authors", "keywords", "abstract")) + """)::DOUBLE AS f0, len(list_filter(toks, lambda x: starts_with(x, 'kerato')))::DOUBLE AS f1 FROM t JOIN a USING (id)),
phs AS (SELECT count(*)::DOUBLE AS n, sum(length) / count(*)::DOUBLE AS avgdl, count(*) FILTER (f0 > 0)::DOUBLE AS d0, count(*) FILTER (f1 > 0)::DOUBLE AS d1 FROM ph),
phr AS (SELECT id, """ + " + ".join(f"greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * (f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)))" for i in range(2)) + " AS score FROM ph, phs WHERE f0 > 0 OR f1 > 0)"
HASHED = f"h AS (SELECT id, sha256({EMBED}) AS text_hash FROM p)"

QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}
SQL = {
    "papers": with_papers("SELECT id, title, array_to_string(authors, '|') AS authors, array_to_string(keywords, '|') AS keywords, abstract, year, doi, url, citation, journal, volume, issue, pages, page_start, page_end FROM p"),
    "split_text_list": with_papers("SELECT id, unnest(range(1, len(authors) + 1)) AS author_no, unnest(authors) AS author FROM p"),
    "keyword_merge": with_papers("SELECT id, unnest(range(1, len(keywords) + 1)) AS keyword_no, unnest(keywords) AS keyword FROM p"),
    "paper_detail": with_papers("SELECT id, title, array_to_string(authors, '|') AS authors, year, array_to_string(keywords, '|') AS keywords, abstract, citation, doi, url FROM p WHERE id = 7"),
    "year_filter": with_papers("SELECT id, year FROM p WHERE year BETWEEN 2015 AND 2020"),
    "author_include": with_papers(f"SELECT id FROM p WHERE {ANY_AUTHOR}"),
    "author_exclude": with_papers(f"SELECT id FROM p WHERE NOT {ANY_AUTHOR}"),
    "author_normalize": with_papers(f"SELECT id, {NORM} AS author_key FROM p"),
    "known_author": with_papers(f"SELECT coalesce(bool_or(contains({NORM}, 'zhuo')), false) AS known FROM p"),
    "surname_filter": with_papers(rf"SELECT id FROM p WHERE len(list_filter(authors, lambda a: regexp_matches(a, '\(\s*龚[一-鿿\s]*\)|^\s*龚'))) > 0"),
    "word_boundary_match": with_papers("SELECT id, regexp_matches(lower(abstract), '(^|[^a-z0-9])mm([^a-z0-9]|$)') AS short_word, contains(lower(title), 'macular h') AS part FROM p"),
    "snippet": with_papers("SELECT id, CASE WHEN length(abstract) > 180 THEN abstract[1:180] || '...' ELSE nullif(abstract, '') END AS abstract_snippet, CASE WHEN length(citation) > 140 THEN citation[1:140] || '…' ELSE citation END AS citation_snippet FROM p"),
    "highlight": with_papers("SELECT id, regexp_replace(title, '(Macular hole|Macular|hole)', '<mark>\\1</mark>', 'gi') AS marked FROM p"),
    "journal_clean": with_papers(f"SELECT id, {clean_journal("'Opt. Soc. ' || coalesce(journal, '') || ' .'")} AS journal FROM p"),
    "author_clean": with_papers(f"SELECT id, array_to_string(list_transform(authors, lambda a: {clean_author('a')}), '|') AS authors FROM p"),
    "ris_export": with_papers(RIS),
    "enw_export": with_papers(ENW),
    "plain_text": with_papers(PLAIN),
    "token_postings": with_papers(f", {TOKENS} SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(toks) AS token FROM a) GROUP BY token, id"),
    "document_frequency": with_papers(f", {TOKENS} SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(toks) AS token FROM a) GROUP BY token"),
    "corpus_stats": with_papers(f", {TOKENS} SELECT count(*) AS n, {r6('sum(length) / count(*)::DOUBLE')} AS avgdl FROM a"),
    "bm25_raw": with_papers(f", {TOKENS}, {bm25(WORDS, 'm')} SELECT id, {r6('score')} AS score FROM m"),
    "bm25_postings_top100": with_papers(f", {TOKENS}, {bm25(WORDS, 'm')} SELECT id, {r6('score')} AS score FROM m ORDER BY m.score DESC, id LIMIT 100"),
    "bm25_posted": with_papers(f", {TOKENS}, {bm25(WORDS, 'm')} SELECT id, {r6('score')} AS score FROM m"),
    "bm25_phrase_scan": with_papers(f", {TOKENS}, {POSITIONS} SELECT id, {r6('score')} AS score FROM phr"),
    "bm25_phrase": with_papers(f", {TOKENS}, {POSITIONS} SELECT id, {r6('score')} AS score FROM phr"),
    "bm25_normalized_top100": with_papers(f", {TOKENS}, {bm25(WORDS, 'm')}, {spread('m', 'fts')} SELECT id, {r6('score')} AS score FROM fts"),
    "keyword_tiers": with_papers(f", {KEYS}, {kw_two(*WORDS)} SELECT id, {r6('score')} AS score FROM keyed WHERE score > 0"),
    "keyword_tiers_han": with_papers(f", {KEYS}, {HAN_KEYS} SELECT id, {r6('score')} AS score FROM kh WHERE score > 0"),
    "lexical_fallback": with_papers(f", {LEXICAL} SELECT id, {r6('score')} AS score FROM lx2 WHERE score > 0 ORDER BY lx2.score DESC, id LIMIT 100"),
    "author_tiers": with_papers(f", {AUTHOR_SCORE} SELECT id, {r6('score')} AS score FROM au2 WHERE score > 0"),
    "author_retrieve": with_papers(f", {AUTHOR_SCORE} SELECT id, {r6('score')} AS score FROM au2 WHERE score > 0 ORDER BY au2.score DESC, id LIMIT 100"),
    "score_map_merge": with_papers(f", {TOKENS}, {DRY_EYE} SELECT id, {r6('score')} AS score FROM raw"),
    "knn_cosine_top100": f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], q) AS cosine FROM embeddings, q) SELECT id, {r6('least(greatest((cosine + 1) / 2, 0), 1)')} AS score FROM d ORDER BY cosine DESC, id LIMIT 100",
    "knn_blobs": with_papers(f", {SEMANTIC} SELECT id, {r6('score')} AS score FROM sem"),
    "embedding_text_hash": with_papers(f", {HASHED} SELECT id, text_hash FROM h"),
    "embedding_freshness": with_papers(f", {HASHED}, own_e AS (SELECT DISTINCT paper_id, text_hash FROM {STORED}) SELECT count(*) AS papers, count(own_e.paper_id) AS fresh, greatest(count(*) - count(own_e.paper_id), 0) AS stale FROM h LEFT JOIN own_e ON own_e.paper_id = h.id AND own_e.text_hash = h.text_hash"),
    "embedding_fresh_rows": with_papers(f", {HASHED} SELECT e.paper_id FROM (SELECT * FROM {STORED} AND octet_length(embedding_blob) = 512) e JOIN h ON e.paper_id = h.id AND e.text_hash = h.text_hash"),
    "embedding_pending": with_papers(f", {HASHED} SELECT id AS paper_id, text_hash FROM h WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {STORED}) e WHERE e.paper_id = h.id AND e.text_hash = h.text_hash)"),
    "embedding_upsert": "SELECT paper_id, provider, model, dimensions, CASE WHEN model = 'eye-embed-2' THEN repeat('0', 64) ELSE text_hash END AS text_hash FROM paper_embeddings",
    "embedding_store": "SELECT paper_id, provider, model, dimensions, CASE WHEN model = 'eye-embed-2' THEN repeat('0', 64) ELSE text_hash END AS text_hash FROM paper_embeddings",
    "recency_score": with_papers(f", {BOUNDS} SELECT id, {r6(RECENCY)} AS recency_score FROM p, b"),
    "lexicon_expansion_join": f"WITH q AS (SELECT DISTINCT {collapse("lower(coalesce(query_raw, ''))")} AS query FROM analytics_events WHERE event_type = 'search'), l(term, expansion) AS (VALUES {LEXICON}) SELECT query, term, expansion FROM q JOIN l ON CASE WHEN regexp_matches(term, '^[a-z]{{1,4}}$') THEN regexp_matches(query, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') ELSE contains(query, term) END",
    "rank_fusion_best_match": FUSED + f"SELECT {COLUMNS} FROM fu ORDER BY {ORDER} LIMIT 50",
    "rank_fusion_most_recent": FUSED + f"SELECT {COLUMNS} FROM (SELECT * FROM fu ORDER BY {ORDER} LIMIT 30) ORDER BY coalesce(year, 0) DESC, final_score DESC, id LIMIT 20",
    "fusion_vector_years": fused_sql(DRY_EYE, QUERY, (0.24, 0.06), "year BETWEEN 2010 AND 2020", SEMANTIC) + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "fusion_author_included": fused_sql(DRY_EYE, QUERY, (0.24, 0.06), f"(contains(lower(array_to_string(authors, ' ')), 'yan gong') OR contains({NORM}, 'yangong'))", author=f"{AUTHOR_SCORE}, {best_hundred('au2', 'aut')}") + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "fusion_author_excluded": fused_sql(recalled(["白内障"], HAN_KEYS.replace("kh AS", "keyed AS", 1), [["congenital", "cataract"]]), "白内障", (0.12, 0.20), f"NOT (contains(lower(array_to_string(authors, ' ')), '龚颜') OR contains({NORM}, '龚颜'))", author=f"{AUTHOR_HAN}, {best_hundred('au2', 'aut')}") + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "fusion_mixed_script": fused_sql(recalled(["oct", "白内障"], kw_two("oct", "白内障"), [["optical", "coherence", "tomography"]]), "oct 白内障", (0.17, 0.15), "year BETWEEN 2014 AND 2024") + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "rank_fusion_scan": FUSED + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "rank_fusion_candidates": FUSED + f"SELECT {COLUMNS}, hits, sources FROM fu",
    "llm_blend": FUSED + f", j AS (SELECT id, (id % 7) / 7.0::DOUBLE AS js FROM fu ORDER BY {ORDER} LIMIT 10) SELECT fu.id, CASE WHEN js IS NULL THEN final_score ELSE {r4('0.75::DOUBLE * final_score + 0.25::DOUBLE * js')} END AS final_score, {r4('js')} AS judge_score FROM fu LEFT JOIN j ON j.id = fu.id",
}
