"""Composite searches built from the parts: routing, exact script search, anchors, guards, fallbacks and traces."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.places import placed
from ..sources.tables import read_table, stored
from .retrieval_queries import BASE_SQL, UNKNOWN_WEIGHT, coverage_search, met_tokens, passages, postings, query_tokens, top_k
from .text_queries import NORM, SOUND_KEY_SQL, SPELL_FROM, SPELL_TO, arabic, q, sql_normalize_arabic

#: Fixed values: (needle in a query, stem in a document) of transliterations, each worth a boost.
HINTS = (
    ("zina", "zny"), ("taqrab", "tqrb"), ("rabbana", "rbna"), ("hasanah", "hsnh"), ("yukallif", "yklf"), ("wusaha", "wsah"),
    ("insan", "nsn"), ("suda", "sd"), ("iyyaka", "ayak"), ("nastain", "nstyn"), ("huwallahu", "allh"), ("ahad", "ahd"),
    ("huwa", "hw"), ("qul", "ql"),
)
HINT, HINT_MANY, HINT_CAP = 0.16, 0.1, 0.38
#: Words that mark English, particle pairs and names that mark transliteration, softer marks.
ENGLISH_MARKS = (
    "the", "not", "don't", "dont", "do", "does", "did", "like", "where", "who", "what", "which", "when", "how", "why",
    "about", "approach", "burden", "soul", "souls", "meaning", "verse", "ayah", "god", "lord", "say", "said", "people",
    "man", "woman", "forbidden", "sin", "mercy", "pray", "prayer", "worship", "help", "world", "hereafter", "paradise",
    "hell", "book", "chapter", "surah", "angel", "angels", "prophet", "messenger", "messengers", "mountain", "mountains",
    "cloud", "clouds", "star", "stars", "earth", "heaven", "heavens", "sky", "sea", "river", "rivers", "fire", "light",
    "darkness", "water", "wind", "tree", "trees", "sun", "moon", "day", "night", "land", "stone", "stones", "sand",
    "rain", "thunder", "lightning", "moving", "move", "passing", "pass", "running", "flowing", "see", "look", "swear",
    "swears", "swore", "believe", "trust", "fear", "love", "hope", "forgive", "forgave", "righteous", "faithful",
    "grateful", "patient", "merciful", "just", "truth", "wrong", "good", "evil", "heart", "hearts", "eye", "eyes",
    "hand", "hands", "face", "tongue", "unto", "upon", "those", "indeed", "surely", "truly", "verily",
)
PARTICLES = r"(^|[^\p{L}\p{N}_])(wa|fa)[ \t\n\r]+(la|ma|bi|li|fi)[ \t\n\r]+"
NAMES = (
    "taqrabu", "yukallifu", "iyyaka", "huwallahu", "huwa", "qul", "ahad", "allahu", "allah", "ayahsabu", "insanu",
    "rabbana",
)
SOFT = (
    "al", "an", "ar", "as", "at", "ad", "az", "wa", "fa", "la", "huwa", "huwallahu", "iyyaka", "yukallifu", "taqrabu",
    "ayahsabu", "insanu", "rabbana", "qul", "ahad", "allahu",
)
#: Tags that stay, and tags whose content goes too.
ALLOWED_TAGS = ("p", "br", "strong", "em", "b", "i", "ul", "ol", "li", "blockquote")
DROPPED_TAGS = ("script", "style")


def words_pattern(words) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)"


def search_type(c: Column) -> Column:
    """Ordered rules: script, too few letters, English marks, strong then soft marks of transliteration, stop words."""
    low = F.lower(F.trim(c))
    letters = F.regexp_count(low, F.lit("[a-z]"))
    words = F.filter(F.split(F.trim(F.regexp_replace(low, "[^a-z]+", " ")), " "), lambda w: w != "")
    stop = F.size(F.filter(words, lambda w: w.isin(*T.TRANSLIT_STOP_WORDS)))
    return (
        F.when(T.detect_script(c) == "arabic", "arabic")
        .when(letters < 3, "english")
        .when(low.rlike(words_pattern(ENGLISH_MARKS)), "english")
        .when(low.rlike(PARTICLES) | low.rlike(words_pattern(NAMES)) | low.rlike(words_pattern(SOFT)), "transliteration")
        .when((stop >= 2) | ((F.size(words) >= 3) & (stop / F.size(words) >= 0.34)), "english")
        .when((F.size(words) <= 8) & (letters / F.greatest(F.length(low), F.lit(1)) > 0.75), "transliteration")
        .otherwise("english")
    )


class Cleaner(HTMLParser):
    """Allowed tags without attributes; text escaped; comments and script or style content gone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in DROPPED_TAGS
        if tag in ALLOWED_TAGS and not self.skip:
            self.out.append(f"<{tag}>")

    def handle_startendtag(self, tag, attrs):
        if tag in ALLOWED_TAGS and not self.skip:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.skip = max(0, self.skip - 1)
        elif tag in ALLOWED_TAGS and tag != "br" and not self.skip:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def clean_html(text: str) -> str:
    parser = Cleaner()
    parser.feed(text or "")
    parser.close()
    return "".join(parser.out).strip()


@F.pandas_udf(StringType())
def sanitize_html(html: pd.Series) -> pd.Series:
    return html.map(clean_html)


#: Short queries of every kind, planted among the turns.
SHORT = ("qul huwa allahu ahad", "wa la taqrabu zina", "alhamdu lillahi rabbil alameen", "mercy", "zz", "he told them of it", "the soul")


def b23_search_type(spark, d):
    short = F.element_at(F.array(*map(F.lit, SHORT)), (F.col("conv_id") % len(SHORT) + 1).cast("int"))
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, short).otherwise(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", search_type(F.when(F.col("conv_id") % 5 == 0, arabic(F.col("t"))).otherwise(F.col("t"))).alias("kind"))


def b26_sanitize_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", sanitize_html("html").alias("clean"))


def offsets(rows: DataFrame, key: str) -> DataFrame:
    """rows with `offset`, their place by key from 0; ties go by the other columns, null keys come first."""
    return placed(rows, key, *[c for c in rows.columns if c != key]).withColumnRenamed("place", "offset")


def a7_fingerprint_offsets(spark, d):
    """Row position of each vector, written back to the rows it belongs to."""
    at = offsets(read_table(spark, d, "embeddings").select("vec_id"), "vec_id")
    docs = read_table(spark, d, "documents").select("doc_id")
    return docs.join(at, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "offset")


def a4_refresh_table(spark, d):
    """Full replacement of a sink table with projected columns; its row count by source."""
    written = stored(read_table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "sink")
    return written.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def a13_boundaries(spark, d):
    """Every tenth order date starts a numbered division."""
    starts = read_table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().filter("dayofyear(day) % 10 = 1")
    per = starts.withColumn("year", F.year("day"))
    count = per.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    before = count.select("year", (F.sum("n").over(Window.orderBy("year")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("year").orderBy("day"))
    return per.withColumn("at", at).join(before, "year").select("day", (F.col("before") + F.col("at")).alias("division"))


def hint_boost(query: Column, text: Column) -> tuple[Column, Column]:
    """(hints met, boost) of needles in the query whose stems stand in the text."""
    met = sum((F.when(F.contains(query, F.lit(a)) & F.contains(text, F.lit(b)), 1).otherwise(0) for a, b in HINTS), F.lit(0))
    return met, boost_of(met)


def boost_of(met: Column) -> Column:
    return F.least(F.lit(HINT_CAP), HINT * met + F.when(met >= 3, HINT_MANY).otherwise(0.0))


def planted(c: Column, key: str, side: int) -> Column:
    """Text followed by the hint words that its id picks, so that hints are met."""
    words = F.array(*[F.lit(h[side]) for h in HINTS])
    return F.concat_ws(" ", F.lower(c), *[F.element_at(words, (F.pmod(F.col(key) * k, F.lit(len(HINTS))) + 1).cast("int")) for k in (1, 3, 5)])


def c15_hint_boost(spark, d):
    """Hints met by every pair of a passage and a document that share a token. Either side's words are looked up once, before
    they meet, and kept as bits."""
    bits = lambda c, side: reduce(lambda a, b: a + b, (F.when(F.contains(c, F.lit(h[side])), 1 << i).otherwise(0) for i, h in enumerate(HINTS)))
    whole = passages(spark, d)
    asked = query_tokens(whole).join(whole.select("query_id", bits(planted(F.col("query"), "query_id", 0), 0).alias("needles")), "query_id")
    docs = read_table(spark, d, "documents").select("doc_id", "text", planted(F.col("text"), "doc_id", 1).alias("t")).select("doc_id", "text", bits(F.col("t"), 1).alias("stems"))
    pairs = met_tokens(asked, docs, "stems").groupBy("query_id", "doc_id").agg(F.first("needles").alias("needles"), F.first("stems").alias("stems"))
    met = F.bit_count(F.col("needles").bitwiseAND(F.col("stems")))
    boost = boost_of(met)
    return pairs.select("query_id", "doc_id", met.cast("long").alias("met"), F.round(boost, 6).alias("boost"))


def targets(spark, d) -> DataFrame:
    """query_id, doc_id of documents that hold a passage: candidates by shared tokens, then containment."""
    passage = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    asked = query_tokens(passages(spark, d))
    per = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    every = met_tokens(asked, docs).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m")).join(per, "query_id").filter("m = n")
    return every.join(passage, "query_id").join(docs, "doc_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")


def d8_f16_first_relevant(spark, d):
    """First rank at which a relevant document stands, null where none does."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    hit = coverage_search(passages(spark, d), docs, 10).join(targets(spark, d), ["query_id", "doc_id"], "left_semi")
    return passages(spark, d).select("query_id").join(hit.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def d15_guard(spark, d):
    """What a wider search (by sound keys) does to the plain one's winners: those among the first three that it lost,
    and first places that moved."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    plain = stored(coverage_search(passages(spark, d), docs, 3).select("query_id", "doc_id", "rank"), "plain")
    sound = lambda df, c: df.withColumn(c, T.phonetic_latin(F.col(c)))
    wide = stored(coverage_search(sound(passages(spark, d), "query"), sound(docs, "text"), 10).select("query_id", "doc_id", "rank"), "wide")
    lost = plain.select("query_id", "doc_id").join(wide, ["query_id", "doc_id"], "left_anti").withColumn("change", F.lit("lost"))
    first = plain.filter("rank = 1").select("query_id", "doc_id")
    moved = first.join(wide.filter("rank = 1"), ["query_id", "doc_id"], "left_anti").withColumn("change", F.lit("moved"))
    return lost.unionByName(moved)


def g3_script_exact(spark, d):
    """Arabic-script search: anchors (the four longest tokens) by equi-join; where a query has exact hits only those
    stay, shorter texts first. A text that holds a query holds its inner words whole, so texts are compared only where they
    have all anchors that stand inside the query, and one at least."""
    docs = stored(read_table(spark, d, "documents").repartition("doc_id").select("doc_id", T.normalize_arabic(arabic(F.col("text"))).alias("norm")), "script")
    queries = passages(spark, d).select("query_id", T.normalize_arabic(arabic(F.col("query"))).alias("qn"))
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3))
    longest = F.slice(F.array_sort(F.transform(tokens(F.col("qn")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1, 4)
    words = F.split("qn", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    anchors = queries.select("query_id", F.explode(F.transform(longest, lambda x: F.struct(x["w"].alias("token"), F.array_contains(inner, x["w"]).cast("int").alias("inner")))).alias("a")).select("query_id", "a.*")
    needed = anchors.groupBy("query_id").agg(F.sum("inner").alias("needed"))
    held = docs.repartition("doc_id").select("doc_id", F.explode(tokens(F.col("norm"))).alias("token"))
    pairs = held.join(anchors, "token").groupBy("query_id", "doc_id").agg(F.sum("inner").alias("found")).join(needed, "query_id").filter("found = needed")
    pairs = pairs.select("query_id", "doc_id").join(queries, "query_id").join(docs, "doc_id")
    exact = pairs.filter(F.contains("norm", "qn")).select("query_id", "doc_id", F.lit(0.98).alias("score"), F.length("norm").cast("long").alias("chars"))
    return top_k(exact, 10, F.desc("score"), F.col("chars"))


def g14_fallback(spark, d):
    """The first query variant with results wins; the whole head comes first, then its first words."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    heads = passages(spark, d)
    variants = heads.select("query_id", F.posexplode(F.array(F.concat(F.lit("zzqx "), F.col("query")), F.substring_index("query", " ", 3), F.col("query"))).alias("variant", "query"))
    each = variants.select((F.col("query_id") * 10 + F.col("variant")).alias("query_id"), "query")
    found = coverage_search(each, docs, 1).filter("score >= 0.99").select((F.expr("query_id div 10")).alias("query_id"), (F.col("query_id") % 10).alias("variant"))
    return found.groupBy("query_id").agg(F.min("variant").alias("variant"))


def g15_trace(spark, d):
    """Per query: its type, tokens, candidates and returned rows."""
    queries = passages(spark, d)
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    asked = query_tokens(queries)
    candidates = asked.join(postings(docs, asked), "token").groupBy("query_id").agg(F.countDistinct("doc_id").alias("candidates"))
    made = queries.select("query_id", search_type(F.col("query")).alias("kind")).join(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens")), "query_id", "left").join(candidates, "query_id", "left")
    return made.select("query_id", "kind", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def d11_f15_anchors(spark, d):
    """Concept anchors: ordered documents of each source, score by ordinal, best over sources, in rank order."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    n = 5
    anchors = read_table(spark, d, "documents").select("source", "doc_id").withColumn("i", at).filter(F.col("i") <= n)
    scored = anchors.select("doc_id", F.round(F.least(F.lit(0.97), 0.93 + (n - F.col("i")) * 0.015), 6).alias("score"))
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "abcdg" and name[1].isdigit()}


def sql_search_type(c: str) -> str:
    low = f"lower(trim({c}))"
    letters = f"len(regexp_extract_all({low}, '[a-z]'))"
    words = f"list_filter(string_split(trim(regexp_replace({low}, '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '')"
    stop = f"len(list_filter({words}, lambda w: w IN ({', '.join(map(q, T.TRANSLIT_STOP_WORDS))})))"
    return f"""CASE WHEN len(regexp_extract_all({c}, '[؀-ۿ]')) > length({c}) * 0.3 THEN 'arabic' WHEN {letters} < 3 THEN 'english' WHEN regexp_matches({low}, {q(words_pattern(ENGLISH_MARKS))}) THEN 'english'
 WHEN regexp_matches({low}, '{PARTICLES}') OR regexp_matches({low}, '{words_pattern(NAMES)}') OR regexp_matches({low}, '{words_pattern(SOFT)}') THEN 'transliteration'
 WHEN {stop} >= 2 OR (len({words}) >= 3 AND {stop} / len({words}) >= 0.34) THEN 'english' WHEN len({words}) <= 8 AND {letters} / greatest(length({low}), 1) > 0.75 THEN 'transliteration' ELSE 'english' END"""


NEEDLES, STEMS = (f"[{', '.join(q(h[side]) for h in HINTS)}]" for side in (0, 1))
SHORT_SQL = f"[{', '.join(map(q, SHORT))}][conv_id % {len(SHORT)} + 1]"
TOP_SQL = f""", w AS (SELECT query_id, token, coalesce(ln((n + 1) / (1.0 + df)) + 1, {UNKNOWN_WEIGHT}) AS w FROM asked LEFT JOIN dfs USING (token), size),
 s AS (SELECT query_id, doc_id, round(sum(w) / (SELECT sum(w) FROM w x WHERE x.query_id = w.query_id), 6) AS score FROM w JOIN posted USING (token) GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""

SQL = {
    "b23_search_type": f"SELECT conv_id, turn, {sql_search_type('t')} AS kind FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN translate(lower(t), 'abcdefghijklmnopqrstuvwxyz', 'ابكدةفجهيحخلمنوثقرسطؤعشصىز') ELSE t END AS t FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN {SHORT_SQL} ELSE text END AS t FROM conversations))",
    "a7_fingerprint_offsets": 'SELECT doc_id, o AS "offset" FROM documents LEFT JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings) ON doc_id = vec_id',
    "a4_refresh_table": "SELECT source, count(*) AS rows FROM documents GROUP BY 1",
    "a13_boundaries": "SELECT day, row_number() OVER (ORDER BY day) AS division FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE dayofyear(day) % 10 = 1",
    "c15_hint_boost": BASE_SQL
    + f""", b AS (SELECT item_id AS query_id, concat_ws(' ', lower(text), {", ".join(f"{NEEDLES}[item_id * {k} % {len(HINTS)} + 1]" for k in (1, 3, 5))}) AS q FROM benchmark),
 t AS (SELECT doc_id, concat_ws(' ', lower(text), {", ".join(f"{STEMS}[doc_id * {k} % {len(HINTS)} + 1]" for k in (1, 3, 5))}) AS t FROM documents),
 h AS (SELECT query_id, doc_id, {' + '.join(f"(contains(q, '{a}') AND contains(t, '{b}'))::BIGINT" for a, b in HINTS)} AS met
 FROM (SELECT DISTINCT query_id, doc_id FROM asked JOIN posted USING (token)) JOIN b USING (query_id) JOIN t USING (doc_id)) SELECT query_id, doc_id, met, round(least({HINT_CAP}, {HINT} * met + CASE WHEN met >= 3 THEN {HINT_MANY} ELSE 0.0 END), 6)::DOUBLE AS boost FROM h""",
    "d8_f16_first_relevant": BASE_SQL + TOP_SQL + " SELECT item_id AS query_id, min(rank) FILTER (WHERE contains(d.text, b.text)) AS rank FROM benchmark b LEFT JOIN ranked r ON r.query_id = item_id AND rank <= 10 LEFT JOIN documents d ON d.doc_id = r.doc_id GROUP BY 1",
    "g3_script_exact": f"""WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents), x AS (SELECT item_id AS query_id, {sql_normalize_arabic(f"translate(lower(text), '{SPELL_FROM}', '{SPELL_TO}')")} AS qn FROM benchmark)
 SELECT query_id, doc_id, 0.98::DOUBLE AS score, length(norm) AS chars, row_number() OVER (PARTITION BY query_id ORDER BY length(norm), doc_id) AS rank FROM d JOIN x ON contains(norm, qn) QUALIFY rank <= 10""",
    "d15_guard": f"""WITH p AS ({BASE_SQL + TOP_SQL} SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 3),
 w AS ({BASE_SQL.replace("FROM documents", f"FROM (SELECT doc_id, {SOUND_KEY_SQL} AS text FROM documents) AS documents").replace("FROM benchmark", f"FROM (SELECT item_id, {SOUND_KEY_SQL} AS text FROM benchmark) AS benchmark") + TOP_SQL} SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10)
 SELECT query_id, doc_id, 'lost' AS change FROM p ANTI JOIN w USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, 'moved' FROM (SELECT * FROM p WHERE rank = 1) ANTI JOIN (SELECT * FROM w WHERE rank = 1) USING (query_id, doc_id)""",
    "g14_fallback": BASE_SQL.replace("FROM benchmark", "FROM (SELECT item_id * 10 + v AS item_id, CASE v WHEN 0 THEN 'zzqx ' || text WHEN 1 THEN array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') ELSE text END AS text FROM benchmark, range(3) AS r(v)) AS benchmark")
    + TOP_SQL
    + " SELECT query_id // 10 AS query_id, CAST(min(query_id % 10) AS BIGINT) AS variant FROM ranked WHERE rank = 1 AND score >= 0.99 GROUP BY 1",
    "g15_trace": BASE_SQL
    + f"SELECT item_id AS query_id, {sql_search_type('text')} AS kind, (SELECT count(*) FROM asked a WHERE a.query_id = item_id) AS tokens, (SELECT count(DISTINCT doc_id) FROM asked a JOIN posted USING (token) WHERE a.query_id = item_id) AS candidates FROM benchmark",
    "d11_f15_anchors": "SELECT doc_id, round(least(0.97, 0.93 + (5 - i) * 0.015), 6)::DOUBLE AS score FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 5",
}
