"""Queries of the engine over the test tables, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import chunking
from .functions import text as T
from .operators import answers as A
from .operators import evaluation as E
from .operators import evidence, fusion, profiles, rerank, search
from .operators import understanding as U
from .plans import answering, retrieval
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_table(spark, f"{sf_dir}/documents.parquet")


_TOKEN = r"[\p{L}\p{N}_\x{00c0}-\x{1ef9}]+"
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stem(t: str) -> str:
    return f"""CASE WHEN regexp_full_match({t}, '[a-z]+') THEN
 CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y'
 WHEN length({t}) > 5 AND regexp_matches({t}, '(ches|shes|sses|xes|zes)$') THEN left({t}, length({t}) - 2)
 WHEN length({t}) > 4 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|sis)$') THEN left({t}, length({t}) - 1)
 ELSE {t} END ELSE {t} END"""


def _tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{_TOKEN}'), lambda w: {_stem('lower(w)')})"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _words(x: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in x) + "]"


def _contains(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


_BM25 = f"""WITH tok AS (SELECT doc_id, {_tokens('text')} AS tokens FROM documents),
 post AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM tok),
 tf AS (SELECT doc_id, length, term, count(*) AS tf FROM post GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
 q AS (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark),
 qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
 s AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))) AS raw
 FROM tf JOIN df USING (term) JOIN qt USING (term), stats GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM s WHERE raw > 0)"""


@query(_BM25 + " SELECT item_id, doc_id, rank, round(raw / max(raw) OVER (PARTITION BY item_id), 6) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_t(spark, sf_dir, "benchmark"), _docs(spark, sf_dir), "item_id", "text", "doc_id", "text", 10)


@query(_BM25 + """ , h AS (SELECT item_id, rank, contains(d.text, b.text) AS relevant FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 10)
 SELECT item_id, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0.0), 6) AS rr, max(relevant AND rank <= 5) AS hit_at_5 FROM h GROUP BY item_id""")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _t(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    top = search.bm25(items, docs, "item_id", "text", "doc_id", "text", 10)
    hits = top.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(items, "item_id").withColumn("relevant", F.col("body").contains(F.col("text")))
    rr = E.reciprocal_rank(hits.select(F.col("item_id").alias("q"), "rank", "relevant"))
    five = hits.groupBy("item_id").agg(F.max(F.col("relevant") & (F.col("rank") <= 5)).alias("hit_at_5"))
    return rr.withColumnRenamed("q", "item_id").withColumn("rr", F.round("rr", 6)).join(five, "item_id")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_df(_docs(spark, sf_dir), "text")


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokenize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query("""WITH p AS (SELECT q.vec_id AS q_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT q_id, vec_id, rank, score FROM r WHERE rank <= 10""")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id")
    return search.vector_topk(asked, vectors, "q_id", "vec_id", "embedding", 10)


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - value)) END AS score FROM events")
def distance_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", search.distance_to_score(F.col("value")).alias("score"))


@query()
def hash_embedding_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hash_embedding(_docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH t AS (SELECT item_id, list_distinct({_tokens('b.text')}) AS a, list_distinct({_tokens("n.text")}) AS b FROM benchmark b LEFT JOIN (SELECT item_id - 1 AS item_id, text FROM benchmark) n USING (item_id))
 SELECT item_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS jaccard FROM t""")
def lexical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "benchmark")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id", "left")
    return pairs.select("item_id", F.round(T.jaccard(T.tokenize(F.col("text")), T.tokenize(F.col("next"))), 6).alias("jaccard"))


_LISTS = """WITH v AS (SELECT user_id AS q, event_id % 97 AS id, max(least(1.0, greatest(0.0, value / 100))) AS score FROM events WHERE event_type = 'view' GROUP BY ALL),
 k AS (SELECT user_id AS q, event_id % 97 AS id, max(least(1.0, greatest(0.0, value / 100))) AS score FROM events WHERE event_type = 'click' GROUP BY ALL),
 s AS (SELECT user_id AS q, event_id % 97 AS id, max(least(1.0, greatest(0.0, value / 100))) AS score FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL)"""


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    score = F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))).alias("score")
    return [events.where(on).groupBy(F.col("user_id").alias("q"), (F.col("event_id") % 97).alias("id")).agg(score) for on in (kind == "view", kind == "click", ~kind.isin("view", "click"))]


@query(_LISTS + """, u AS (SELECT q, id, score AS v, 0.0 AS k, 0.0 AS s, 1 AS l FROM v UNION ALL SELECT q, id, 0.0, score, 0.0, 2 FROM k UNION ALL SELECT q, id, 0.0, 0.0, score, 3 FROM s),
 g AS (SELECT q, id, max(v) AS v, max(k) AS k, max(s) AS s, 0.7::DOUBLE * max(v) + (1 - 0.7::DOUBLE) * max(k) AS m FROM u GROUP BY ALL), h AS (SELECT q, bool_or(l = 1) AS hv, bool_or(l = 2) AS hk, bool_or(l = 3) AS hs FROM u GROUP BY q)
 SELECT q, id, round(v, 6) AS vector_score, round(k, 6) AS keyword_score, round(s, 6) AS section_score, round(CASE WHEN hv AND hk AND hs THEN greatest(m, 0.65::DOUBLE * s + 0.35::DOUBLE * m)
 WHEN hv AND hk THEN m WHEN hs THEN greatest(v, k, s) WHEN hv THEN v ELSE k END, 8) AS score FROM g JOIN h USING (q)""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.merge(*_lists(spark, sf_dir))
    return found.select("q", "id", *[F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "section_score")], F.round("score", 8).alias("score"))  # 7 places at most, so no tie


@query(_LISTS + """, u AS (SELECT 1 AS l, * FROM v UNION ALL SELECT 2, * FROM k UNION ALL SELECT 3, * FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY q, l ORDER BY score DESC, id) AS rank FROM u),
 g AS (SELECT q, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS base FROM r GROUP BY ALL),
 n AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY q) AS rs FROM g), o AS (SELECT *, least(1.0, 0.85 * base + 0.15 * rs) AS score FROM n),
 p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 9) DESC, round(score, 9) DESC, id) AS place FROM o)
 SELECT q, id, place, round(score, 6) AS score FROM p WHERE place <= 5""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    one, two, three = (df.withColumn("rank", F.row_number().over(w)) for df in _lists(spark, sf_dir))
    return fusion.rrf(one.unionByName(two).unionByName(three), 5).select("q", "id", "place", F.round("score", 6).alias("score"))


@query(_LISTS + " SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM v WHERE score >= 0.3) WHERE rank <= 5")
def threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.threshold_topk(_lists(spark, sf_dir)[0], 0.3, 5).select("q", "id", "rank")


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _t(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    top = search.bm25(items, docs, "item_id", "text", "doc_id", "text", 40)
    rows = top.join(docs.select("doc_id", T.tokenize(F.col("text")).alias("terms")), "doc_id").join(items.select("item_id", T.tokenize(F.col("text")).alias("query_terms")), "item_id")
    return fusion.mmr(rows.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "score", "terms", "query_terms"), 5)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark passage, which stands for the question."""
    items, docs = _t(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    top = search.bm25(items, docs, "item_id", "text", "doc_id", "text", 5)
    top = files.written(top, "top")
    rows = search.only(docs.select("doc_id", "text"), top, "doc_id").join(top, "doc_id").join(items.select("item_id", F.col("text").alias("question")), "item_id")
    return rows.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "question", "text", "score", F.lit(None).cast("string").alias("section_title"))


@query()
def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.entity_filter(_passages(spark, sf_dir)).select("q", "id", F.round("score", 6).alias("score"), "entity_mismatch")


_INTENT = "CASE " + " ".join(f"WHEN {_contains('lower(text)', p)} THEN '{k}'" for k, p in U.INTENTS.items()) + " ELSE 'qa' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations")
def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", U.intent(F.col("text")).alias("intent"))


@query(f"""SELECT conv_id, turn, coalesce(regexp_matches(lower(text), '[{U.VIETNAMESE}]') OR len(list_intersect(string_split({_squeeze("translate(lower(text), 'đơư', 'dou')")}, ' '), {_words(U.VIETNAMESE_WORDS)})) > 0, false) AS vietnamese
 FROM conversations""")
def vietnamese_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", U.is_vietnamese(F.col("text")).alias("vietnamese"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_tokens('text')} AS k FROM conversations)
 SELECT conv_id, turn, CASE WHEN coalesce(list_contains({_words(U.YES_NO)}, k[1]), false) OR len(list_intersect(k, {_words(U.CLAIM_MARKERS)})) > 0 THEN 'claim_verification' ELSE 'answer' END AS behavior FROM t""")
def behavior_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", U.behavior(F.col("text")).alias("behavior"))


_STRIP = f"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
_LAST = f"""last_value(CASE WHEN role = 'user' AND coalesce(text, '') <> '' THEN {_STRIP % 'text'} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT conv_id, turn, {_LAST} AS previous FROM conversations")
def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_last_user_message(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "previous")


@query(f"""WITH p AS (SELECT conv_id, turn, {_STRIP % "coalesce(text, '')"} AS q, {_LAST} AS previous FROM conversations),
 t AS (SELECT *, regexp_extract_all(lower(q), '{_TOKEN}') AS k FROM p)
 SELECT conv_id, turn, CASE WHEN len(k) > 0 AND (len(list_intersect(k, {_words(U.FOLLOW_WORDS)})) > 0 OR {_contains('lower(q)', U.FOLLOW_PHRASES)} OR (NOT list_contains({_words(U.STARTERS)}, k[1]) AND len(k) <= 3))
 AND coalesce(previous, '') <> '' THEN previous || chr(10) || 'Follow-up: ' || q ELSE q END AS query FROM t""")
def followup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.with_last_user_message(_t(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", U.rewrite_follow_up(F.col("text"), F.col("previous")).alias("query"))


@query()
def claim_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Does the paper say that "), F.col("text"), F.lit("?"))
    return _t(spark, sf_dir, "benchmark").select("item_id", U.rewrite_claim(said).alias("query"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_INTENT} AS kind, len({_tokens('text')}) <= 7 AND len(list_filter({_tokens('text')}, lambda w: (length(w) > 2 OR w = 'ai') AND NOT list_contains({_words(T.RETRIEVAL_STOPS)}, w))) <= 3 AS short
 FROM conversations), k AS (SELECT *, CASE WHEN kind = 'summary' THEN 10 WHEN kind <> 'qa' THEN 7 WHEN short THEN 4 ELSE 5 END AS top_k FROM t)
 SELECT conv_id, turn, top_k, CASE WHEN kind = 'summary' THEN 0.0 WHEN kind <> 'qa' THEN 0.2 WHEN short THEN 0.35 ELSE 0.3 END::DOUBLE AS threshold,
 greatest(CASE WHEN kind <> 'qa' OR short THEN 6 * top_k ELSE 8 * top_k END, CASE WHEN kind = 'summary' THEN 60 WHEN kind <> 'qa' THEN 50 WHEN short THEN 30 ELSE 40 END) AS candidate_k, kind <> 'qa' AS force_parent FROM k""")
def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", U.retrieval_plan(F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


@query(f"""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''), w AS (SELECT doc_id, unnest(range(0, greatest(0, ceil((n - 900) / 750.0))::BIGINT + 1)) AS i, text FROM n)
 SELECT doc_id, i AS place, {_STRIP % "substr(text, i * 750 + 1, 900)"} AS chunk FROM w WHERE {_STRIP % "substr(text, i * 750 + 1, 900)"} <> ''""")
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - 900) / F.lit(750))).cast("int")
    rows = _docs(spark, sf_dir).where("text <> ''").select("doc_id", text, F.explode(F.sequence(F.lit(0), last)).alias("place"))
    cut = rows.select("doc_id", F.col("place").cast("long").alias("place"), T.strip(F.substring(text, F.col("place") * 750 + 1, F.lit(900))).alias("chunk"))
    return cut.where("chunk <> ''")


@query("SELECT doc_id, CASE WHEN length(text) <= 3000 THEN text ELSE regexp_replace(substr(text, 1, 3000), ' [^ ]*$', '') END AS parent FROM documents")
def parent_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.trim_parent(F.col("text")).alias("parent"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\f\\x0b]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def collapse_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.collapse(F.col("text")).alias("text"))


@query("SELECT lang, count(*) AS n, min(length(coalesce(text, ''))) AS shortest, max(length(coalesce(text, ''))) AS longest, round(avg(length(coalesce(text, ''))), 2) AS mean, sum(length(coalesce(text, '')))::BIGINT AS total FROM documents GROUP BY lang")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(*files.text_stats(F.col("text")))


@query(f"SELECT doc_id, CASE WHEN length({_squeeze('text')}) <= 120 THEN {_squeeze('text')} ELSE substr({_squeeze('text')}, 1, 117) || '...' END AS short FROM documents")
def shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.shorten(F.col("text"), 120).alias("short"))


@query()
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunking.clean(F.col("text")).alias("text"))


def _document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("text", F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("file_name"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("paragraph_index"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_document_rows(spark, sf_dir), raw=True)


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_document_rows(spark, sf_dir), raw=True, parents=False)


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')
 SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || """ + _STRIP % "text" + """, chr(10) ORDER BY turn) AS history FROM m WHERE b <= 8 GROUP BY conv_id""")
def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chat_history(_t(spark, sf_dir, "conversations"))


@query()
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, chunks = _t(spark, sf_dir, "benchmark"), _searched(spark, sf_dir)
    top = search.bm25(items, chunks, "item_id", "text", "chunk_id", "text", 10)
    top = files.written(top, "top")
    top = search.only(chunks, top, "chunk_id").join(top, "chunk_id")
    return A.context(top.select(F.col("item_id").alias("q"), "rank", "file_name", "page", "chunk_id", "text"))


@query(f"SELECT conv_id, turn, lower({_squeeze('t')}) IN ('{A.REFUSAL_EN.lower()}', '{A.REFUSAL_VI.lower()}') AS refusal, regexp_matches(t, '\\[\\d+(\\s*,\\s*\\d+)*\\]') AS cited, {_contains('lower(' + _squeeze('t') + ')', E.UNSUPPORTED)} AS unsupported FROM (SELECT *, coalesce(text, '') AS t FROM conversations)")
def refusal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", A.is_refusal(text).alias("refusal"), text.rlike(A.CITATION).alias("cited"), E.claim_unsupported(text).alias("unsupported"))


@query()
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = U.with_last_user_message(_t(spark, sf_dir, "conversations")).where("role = 'assistant' and text is not null")
    return turns.select("conv_id", "turn", A.normalize_answer(F.col("text"), F.coalesce("previous", F.lit("")), F.lit(True)).alias("answer"))


@query()
def context_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _t(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    top = search.bm25(items, docs, "item_id", "text", "doc_id", "text", 1).join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(items, "item_id")
    return top.select("item_id", A.support(F.col("text"), F.col("body"), F.col("score"), F.lit(0.0)).alias("support"))


@query("""WITH k AS (SELECT doc_id, lower(text) AS t, list_filter(list_transform(string_split(lang || '; ' || source || ' ;the', ';'), lambda x: trim(x)), lambda x: x <> '') AS k FROM documents)
 SELECT doc_id, round(len(list_filter(k, lambda x: contains(coalesce(t, ''), lower(x)))) / len(k), 6) AS rate FROM k""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = E.parse_keywords(F.concat(F.col("lang"), F.lit("; "), F.col("source"), F.lit(" ;the")))
    return _docs(spark, sf_dir).select("doc_id", F.round(E.keyword_rate(words, F.col("text")), 6).alias("rate"))


@query("""WITH b AS (SELECT event_id, event_id % 3 > 0 AS a, event_id % 4 > 0 AS p, event_id % 5 > 1 AS h, event_id % 7 AS n, (event_id % 7) / 7.0 AS r, (event_id % 11) / 11.0 AS t FROM events),
 s AS (SELECT event_id, CASE WHEN a AND p AND h THEN CASE WHEN r < 0.3 THEN 'WARNING/PAGE_HIT_KEYWORD_LOW' ELSE 'OK/OK' END WHEN a AND p THEN CASE WHEN r >= 0.3 THEN 'FAIL/PAGE_MISMATCH' WHEN n > 0 THEN 'FAIL/ENTITY_MATCH_WRONG_EVENT' ELSE 'FAIL/RETRIEVAL_MISS' END
 WHEN a AND r < 0.3 THEN CASE WHEN n > 0 THEN 'FAIL/ENTITY_MATCH_WRONG_EVENT' ELSE 'FAIL/RETRIEVAL_MISS' END WHEN t < 0.25 THEN 'WARNING/LOW_CONFIDENCE_RETRIEVAL' WHEN NOT a AND t >= 0.6 THEN 'WARNING/OOS_HIGH_CONFIDENCE' ELSE 'OK/OK' END AS s FROM b)
 SELECT event_id, s AS status FROM s""")
def retrieval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    s = E.retrieval_status(n % 3 > 0, n % 4 > 0, n % 5 > 1, n % 7, (n % 7) / 7.0, (n % 11) / 11.0)
    return _t(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", F.concat_ws("/", "s.status", "s.reason").alias("status"))


def _mean(x: str, on: str = "true", none: str = "0.0") -> str:
    return f"round(coalesce(avg(CASE WHEN {on} THEN {x} END), {none}), 6)"


@query(f"""SELECT count(*) AS total_questions, count(*) FILTER (q) AS answerable_questions, count(*) FILTER (NOT q) AS unanswerable_questions,
 {_mean('d % 10 / 10.0', 'q')} AS mean_keyword_hit_rate, {_mean('CASE WHEN d % 10 >= 3 THEN 1.0 ELSE 0.0 END', 'q')} AS keyword_recall_at_5,
 {_mean('CASE WHEN d % 3 = 0 THEN 1.0 ELSE 0.0 END', 'q AND d % 2 = 0')} AS page_recall_at_5, {_mean('CASE WHEN d % 3 = 0 OR d % 10 >= 3 THEN 1.0 ELSE 0.0 END', 'q')} AS evidence_hit_at_5,
 {_mean('1.0 / (1 + d % 5)', 'q')} AS mrr, {_mean('CASE WHEN q THEN d % 7 / 7.0 END', none='NULL')} AS citation_accuracy, NULL::DOUBLE AS citation_strict_accuracy,
 NULL::DOUBLE AS citation_page_accuracy, NULL::DOUBLE AS citation_keyword_support, NULL::DOUBLE AS citation_weighted_score, {_mean('CASE WHEN NOT q THEN toxic::DOUBLE END', none='NULL')} AS refusal_accuracy,
 NULL::DOUBLE AS unsupported_claim_accuracy, {_mean('toxic::DOUBLE', none='NULL')} AS expected_behavior_accuracy, {_mean('toxic::DOUBLE', 'q')} AS false_refusal_rate, {_mean('d % 100 / 8.0')} AS average_latency_seconds
 FROM (SELECT doc_id AS d, quality = 1 AS q, toxic FROM labels)""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, yes, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic").cast("double")
    rows = _t(spark, sf_dir, "labels").select(
        yes.alias("is_answerable"),
        (d % 2 == 0).alias("has_pages"),
        (d % 10 / 10.0).alias("keyword_rate"),
        (d % 10 >= 3).cast("double").alias("keyword_recall"),
        (d % 3 == 0).cast("double").alias("page_recall"),
        ((d % 3 == 0) | (d % 10 >= 3)).cast("double").alias("evidence_hit"),
        (1.0 / (1 + d % 5)).alias("rr"),
        F.when(yes, d % 7 / 7.0).alias("citation_accuracy"),
        F.when(~yes, toxic).alias("refusal_accuracy"),
        toxic.alias("behavior_accuracy"),
        toxic.alias("false_refusal"),
        (d % 100 / 8.0).alias("latency"),
    )
    return E.summarize(rows)


@query("""WITH r AS (SELECT doc_id AS item, quality * 2 + toxic AS stratum, row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY doc_id) AS n FROM labels)
 SELECT item, stratum FROM r ORDER BY n > 5, item LIMIT 30""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") * 2 + F.col("toxic")).alias("stratum"), F.col("doc_id").alias("ord"))
    return E.stratified(rows, 30, 5)


@query("SELECT conv_id, turn, sha256(encode(conv_id::VARCHAR) || '\\x00'::BLOB || encode(coalesce(text, '')) || '\\x00'::BLOB) AS cache_key FROM conversations")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", E.cache_key(F.col("conv_id"), F.col("text")).alias("cache_key"))


@query()
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    chunks = _searched(spark, sf_dir).select("chunk_id", "file_name", "page", "text")
    return answering.answer(asked, chunks)


#: Rules for the queries below: words of the test tables' four languages.
PROFILE = {
    "query_expansions": {"the": ["article", "definite"], "in the": ["inside"], "und": ["sowie"], "que": ["lequel", "quoi"], "los": ["las"]},
    "section_intents": {"frequent": {"query_terms": ["the", "und"], "section_terms": ["the", "und", "les"]}},
    "retrieval_intents": {"english": {"query_terms": ["the", "and"], "section_terms": ["the"], "phrase_terms": ["of the", "in the", "that"]}, "other": {"query_terms": ["les", "und", "las"], "section_terms": ["les"], "phrase_terms": ["und die", "de la"]}},
}


def _rules() -> str:
    parts = []
    for trigger, terms in PROFILE["query_expansions"].items():
        parts.append(f"CASE WHEN len(list_intersect(k, {_words(T.plain_tokens(trigger))})) = {len(T.plain_tokens(trigger))} THEN {_words(terms)} ELSE [] END")
    return "flatten([" + ", ".join(parts) + "])"


@query(f"""WITH c AS (SELECT conv_id, turn, text, {_tokens('text')} AS k FROM conversations), a AS (SELECT *, list_filter({_rules()}, lambda x: NOT contains(lower(text), x)) AS added FROM c)
 SELECT conv_id, turn, CASE WHEN len(added) > 0 THEN text || chr(10) || 'Related retrieval terms: ' || array_to_string(added, ', ') ELSE text END AS query FROM a""")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", profiles.expand_query(F.col("text"), PROFILE).alias("query"))


@query()
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.posexplode(profiles.query_variants(profiles.expand_query(F.coalesce("text", F.lit("")), PROFILE), 4)).alias("place", "variant")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", forms)


@query(rf"""WITH w AS (SELECT doc_id, text, list_filter(string_split(coalesce(lang, '') || '-' || coalesce(source, '') || ';q1_' || doc_id % 3, ';'), lambda x: x <> '') AS k FROM documents),
 n AS (SELECT doc_id, trim(coalesce(text, '')) <> '' AS ok, k, replace(replace(replace(replace(lower(coalesce(text, '')), 'q1', ' quarter 1 '), 'q2', ' quarter 2 '), 'q3', ' quarter 3 '), 'q4', ' quarter 4 ') AS l,
 list_transform(k, lambda x: translate(replace(lower(x), 'q1', ' quarter 1 '), '-_', '  ')) AS m FROM w), t AS (SELECT doc_id, ok, k, translate(l, '-_', '  ') AS l, m FROM n),
 b AS (SELECT doc_id, ok, k, m, l, regexp_replace(l, '[^\p{{L}}\p{{N}}]', '', 'g') AS c, list_distinct({_tokens('l')}) AS lt FROM t)
 SELECT doc_id, CASE WHEN ok THEN round(len(list_filter(m, lambda x: contains(l, x) OR (regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g') <> '' AND contains(c, regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')))
 OR (len(lt) > 0 AND len({_tokens('x')}) > 0 AND len(list_intersect(list_distinct({_tokens('x')}), lt)) / len(list_distinct(list_concat(list_distinct({_tokens('x')}), lt))) >= 0.6))) / len(k), 6) ELSE 0.0 END AS coverage FROM b""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = E.parse_keywords(F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), F.coalesce("source", F.lit("")), F.lit(";q1_"), (F.col("doc_id") % 3).cast("string")))
    return _docs(spark, sf_dir).select("doc_id", F.round(E.keyword_coverage(words, F.col("text")), 6).alias("coverage"))


@query("""WITH b AS (SELECT event_id AS e, [event_id % 4, event_id % 9] AS gold, CASE WHEN event_id % 6 = 0 THEN [] ELSE [event_id % 5, event_id % 3] END AS pages, list_distinct([(event_id % 3)::INT, (event_id % 2)::INT + 1]) AS ids FROM events),
 c AS (SELECT *, list_transform(list_filter(ids, lambda i: i >= 1 AND i <= len(pages)), lambda i: pages[i]) AS cited FROM b),
 d AS (SELECT *, CASE WHEN len(list_intersect(cited, gold)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS page, CASE WHEN list_contains(cited, e % 3) THEN 0.5 ELSE 0.0 END::DOUBLE AS keyword FROM c)
 SELECT e AS event_id, page, keyword, round(0.6::DOUBLE * page + 0.4::DOUBLE * keyword, 6) AS weighted, CASE WHEN page >= 1 AND keyword >= 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS relaxed, len(list_intersect(pages, gold)) > 0 AS page_hit FROM d""")
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    gold = F.array(e % 4, e % 9)
    pages = F.when(e % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(e % 5, e % 3))
    answer = F.concat(F.lit("So it is ["), (e % 3).cast("string"), F.lit(", "), (e % 2 + 1).cast("string"), F.lit("]."))
    texts = F.transform(pages, lambda p: F.concat(F.lit("page-"), p.cast("string"), F.lit(".")))
    keywords = F.array(F.concat(F.lit("PAGE-"), (e % 3).cast("string"), F.lit(".")), F.lit("never"))
    found = _t(spark, sf_dir, "events").select("event_id", E.citation_scores(answer, gold, keywords, pages, texts).alias("s"), E.page_hit(gold, pages).alias("page_hit"))
    return found.select("event_id", "s.page", "s.keyword", F.round("s.weighted", 6).alias("weighted"), "s.relaxed", "page_hit")


@query("""WITH b AS (SELECT event_id, event_id % 2 = 0 AS a, ['answer', 'refuse', 'state_not_supported'][event_id % 3 + 1] AS x, event_id % 5 < 2 AS r, event_id % 7 < 3 AS u FROM events)
 SELECT event_id, CASE WHEN NOT a AND x = 'refuse' THEN r::INT::DOUBLE END AS refusal, CASE WHEN x = 'state_not_supported' THEN (r OR u)::INT::DOUBLE END AS unsupported_claim,
 CASE WHEN NOT a AND x = 'refuse' THEN r::INT::DOUBLE WHEN NOT a AND x = 'state_not_supported' THEN (r OR u)::INT::DOUBLE END AS expected_behavior, a AND r AS false_refusal FROM b""")
def behavior_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    expected = F.element_at(F.array(F.lit("answer"), F.lit("refuse"), F.lit("state_not_supported")), (e % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", E.behavior_scores(e % 2 == 0, expected, e % 5 < 2, e % 7 < 3).alias("s")).select("event_id", "s.*")


@query()
def answer_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = U.with_last_user_message(_t(spark, sf_dir, "conversations")).where("role = 'assistant'")
    level = F.when(F.col("turn") % 2 == 0, "NO_SUPPORT").otherwise("STRONG_SUPPORT")
    behavior = F.when(F.col("turn") % 3 == 0, "state_not_supported").otherwise("answer")
    return turns.select("conv_id", "turn", A.postprocess(F.col("text"), F.coalesce("previous", F.lit("")), level, behavior).alias("answer"))


def _hits(spark: SparkSession, sf_dir: str, top_k: int) -> DataFrame:
    """The best chunks of each benchmark passage, which stands for the question."""
    items, chunks = _t(spark, sf_dir, "benchmark"), chunk_documents(spark, sf_dir)
    top = search.bm25(items, _searched(spark, sf_dir), "item_id", "text", "chunk_id", "text", top_k)
    asked = items.select("item_id", F.col("text").alias("question"))
    top = files.written(top, "top")
    rows = search.only(chunks.select("chunk_id", "file_name", "page", "section_title", "text", "parent_text"), top, "chunk_id").join(top, "chunk_id").join(asked, "item_id")
    zero = F.lit(0.0)
    rows = rows.select(F.col("item_id").alias("q"), "question", F.col("chunk_id").alias("id"), "rank", "score", F.col("score").alias("keyword_score"), zero.alias("vector_score"), zero.alias("section_score"), "section_title", "text", "parent_text", "file_name", "page")
    return files.written(rows, "hits")


@query()
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(_hits(spark, sf_dir, 20)).where("place <= 10").select("q", "id", "place", F.round("rerank_score", 6).alias("rerank_score"))


@query()
def evidence_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    boost = profiles.evidence_boost(F.col("question"), F.col("section_title"), F.col("text"), PROFILE)
    return _hits(spark, sf_dir, 20).select("q", "id", F.round(boost, 6).alias("boost"))


@query()
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.expand_parents(_hits(spark, sf_dir, 10)).select("q", "id", "text", F.col("matched_text").isNotNull().alias("expanded"))


@query()
def evidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.guard(_hits(spark, sf_dir, 5).select("q", "question", "section_title", "text")).select("q", "sufficient")


@query()
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages against documents whose first words stand for a title."""
    titled = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 6), " ").alias("section_title"), "text")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    return evidence.section_search(asked, titled, 10, PROFILE).select("q", "id", "rank", F.round("score", 6).alias("score"))


@query()
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the first sentences of the third hit, which cite the first one, against the five best chunks."""
    hits = _hits(spark, sf_dir, 5)
    said = F.concat(F.substring("text", 1, 400), F.lit(" [1]."))
    answers = hits.where("rank = 3").select("q", "question", said.alias("answer"))
    return A.check_citations(answers, hits.select("q", "rank", "text"))


@query()
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    found = retrieval.retrieve(asked, chunk_documents(spark, sf_dir), auto=True, profile=PROFILE)
    return found.select("q", "place", "id", F.round("score", 6).alias("score"), F.col("matched_text").isNotNull().alias("expanded"))


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search with and without reranking; a passage is its own keyword."""
    hits = _hits(spark, sf_dir, 10)
    plain = hits.select(F.lit("keyword").alias("variant"), "q", "rank", "page", "text")
    anew = rerank.rerank(hits).select(F.lit("keyword, reranked").alias("variant"), "q", F.col("place").alias("rank"), "page", "text")
    questions = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.lit(True).alias("is_answerable"), F.array().cast("array<int>").alias("source_pages"), F.array("text").alias("expected_keywords"))
    return E.ablation(plain.unionByName(anew), questions).select("variant", "total_questions", "mean_keyword_hit_rate", "keyword_recall_at_5", "evidence_hit_at_5", "mrr")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
