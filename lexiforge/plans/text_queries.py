"""Text expressions over whole tables, each beside DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read_table

#: Latin letters spelled in Arabic script, so that the given tables yield Arabic text.
SPELL_FROM, SPELL_TO = "abcdefghijklmnopqrstuvwxyz", "ابكدةفجهيحخلمنوثقرسطؤعشصىز"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def arabic(c):
    return F.translate(F.lower(c), SPELL_FROM, SPELL_TO)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replaced(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


ENGLISH_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'))"
ARABIC_TEXT = f"translate(lower(text), '{SPELL_FROM}', '{SPELL_TO}')"


def sql_list(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sql_tokens(c: str, query: bool = False) -> str:
    norm = ENGLISH_SQL.replace("lower(text)", f"lower({c})")
    return f"list_filter(regexp_extract_all({norm}, '[a-z'']+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list((*T.STOP_WORDS, *(T.QUERY_WORDS if query else ())))}, w))"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r]+', ' ', 'g'))"


def sql_normalize_arabic(c: str) -> str:
    c = f"regexp_replace(translate({c}, 'ـ', ''), {q(T.MARKS)}, '', 'g')"
    c = f"translate({c}, '{T.FOLD_FROM}{T.FOLD_DROP}', '{T.FOLD_TO}')"
    c = f"regexp_replace(regexp_replace({c}, {q(T.ARABIC_PUNCTUATION)}, ' ', 'g'), '[^؀-ۿ \\t\\n\\r]', '', 'g')"
    # no back references here: runs of one letter are cut letter by letter
    for letter in (*dict.fromkeys(SPELL_TO.translate(str.maketrans(T.FOLD_FROM, T.FOLD_TO))), " "):
        c = f"regexp_replace({c}, '{letter}{{3,}}', '{letter}{letter}', 'g')"
    return sql_squeeze(c)


def normalize_english(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_english(F.col("text")).alias("norm"))


def paraphrase(spark, d):
    return docs(spark, d).select("doc_id", T.paraphrase(T.normalize_english(F.col("text"))).alias("hinted"))


def content_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.content_tokens(F.col("text")), " ").alias("tokens"), F.size(T.content_tokens(F.col("text"), True)).cast("long").alias("n_query_tokens"))


def normalize_translit(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_translit(F.col("text")).alias("translit"), T.phonetic_latin(F.col("text")).alias("sound"))


def arabic_keys(spark, d):
    text = docs(spark, d).select("doc_id", arabic(F.col("text")).alias("text"))
    norm = text.select("doc_id", "text", F.explode(F.array(T.normalize_arabic(F.col("text")))).alias("norm"))  # computed once
    made, _ = T.prepare_translit(F.col("text"), F.when(F.col("doc_id") % 7 == 0, F.lit(" given ")).when(F.col("doc_id") % 7 == 1, F.lit(" ")))
    return norm.select("doc_id", "norm", T.phonetic_of_normalized(F.col("norm")).alias("sound"), made.alias("latin"), T.strip_marks(F.col("text")).alias("unmarked"))


def intent_wrapper(spark, d):
    said = F.concat_ws(" ", F.element_at(F.array(F.lit("verse about"), F.lit("Where God says"), F.lit("the chapter"), F.lit("quran verses on")), (F.col("turn") % 4 + 1).cast("int")), F.col("text"))
    return read_table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", T.strip_intent_wrapper(said).alias("concept"))


def char_ngrams(spark, d):
    return read_table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.char_ngrams(F.col("p_name"))), "|").alias("grams"), F.array_join(T.word_ngrams(F.split("p_name", " "), 2), "|").alias("pairs"))


def stem_roots(spark, d):
    words = F.split(T.normalize_english(F.col("text")), " ")
    return docs(spark, d).select("doc_id", F.array_join(T.stem_roots(words, ("un", "re", "de"), ("ing", "ed", "en", "s")), " ").alias("roots"))


def token_variants(spark, d):
    words = F.filter(F.split(T.normalize_arabic(arabic(F.col("text"))), " "), lambda w: w != "")
    counted = docs(spark, d).select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("token", "n", F.array_join(F.array_sort(T.token_variants(F.col("token"))), " ").alias("variants"))


def detect_script(spark, d):
    mixed = F.when(F.col("doc_id") % 3 == 0, arabic(F.col("text"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", T.detect_script(mixed).alias("script"), F.length(T.clamp(F.col("text"))).cast("long").alias("clamped"))


def content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("chars"))


def html_text(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


def keys(spark, d):
    made = F.concat_ws(":", (F.col("l_orderkey") % 130).cast("string"), F.col("l_linenumber").cast("string"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", made.alias("key"), T.parse_key(made).alias("k")).select("l_orderkey", "l_linenumber", "key", F.col("k.group").alias("group_no"), F.col("k.ordinal").alias("ordinal"), F.col("k").isNotNull().alias("valid"))


def media_url(spark, d):
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    voices = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 != 0).alias("enabled"))
    voice = F.when(F.col("enabled"), F.col("s_suppkey")).otherwise(F.lit(1)).cast("string")
    file = F.concat(F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(".mp3"))
    joined = items.join(voices, items.l_suppkey == voices.s_suppkey)
    return joined.select("l_orderkey", "l_linenumber", F.concat_ws("/", F.lit("https://media.example"), voice, file).alias("url"), F.when(voice != "1", F.concat_ws("/", F.lit("https://media.example/1"), file)).alias("fallback"))


def fingerprint(spark, d):
    v = T.phonetic_fingerprint(F.col("p_name"))
    made = read_table(spark, d, "part").select("p_partkey", F.explode(F.array(F.transform(v, lambda x: F.round(x, 6)))).alias("v"))  # computed once
    return made.select("p_partkey", *[F.col("v")[i].alias(f"v{i}") for i in range(13)])


def highlight(spark, d):
    """Every document that holds a passage's rarest term, with all of the passage's terms marked."""
    terms = read_table(spark, d, "benchmark").select("item_id", F.array_distinct(T.content_tokens(F.col("text"), True)).alias("terms")).filter("size(terms) > 0")
    texts = docs(spark, d).select("doc_id", "text", T.content_tokens(F.col("text")).alias("tokens"))
    held = texts.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(terms.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = terms.select("item_id", F.explode("terms").alias("term")).join(df, "term").groupBy("item_id").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    pattern = F.concat(F.lit("("), F.array_join("terms", "|"), F.lit(")"))
    met = rarest.join(held, "term").join(terms, "item_id").join(texts.select("doc_id", "text"), "doc_id")
    return met.select("item_id", "doc_id", F.regexp_replace(F.lower("text"), pattern, F.lit("[$1]")).alias("marked"))


def mark_tokens(spark, d):
    marks = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[.,;:!?]+|[^.,;:!?]+"), F.lit(0))).alias("t"))
    kind = F.when(F.col("t").rlike("^[.!?]+$"), "stop").when(F.col("t").rlike("^[,;:]+$"), "pause").when(F.col("t").rlike("^[.,;:!?]"), "mixed").otherwise("plain")
    return marks.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def normalize_records(spark, d):
    raw = docs(spark, d).select(F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("number"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, "x").otherwise(""))).alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("body"))).alias("j"))
    r = raw.select(F.from_json("j", "number long, id string, body string").alias("r")).select(F.coalesce("r.number", F.col("r.id").try_cast("long")).alias("ordinal"), F.trim("r.body").alias("body"))
    return r.filter("ordinal IS NOT NULL AND body <> ''")


def arabic_formula(spark, d):
    ordinal = F.pmod("doc_id", F.lit(3))
    group = F.pmod("doc_id", F.lit(12))
    opening = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(T.FORMULA), F.lit(" "), arabic(F.col("text")))).when(F.col("doc_id") % 4 == 1, F.lit(T.FORMULA)).otherwise(arabic(F.col("text")))
    norm = T.normalize_arabic(opening)
    return docs(spark, d).select("doc_id", T.strip_formula_for_search(norm, group, ordinal).alias("searched"), T.strip_formula_for_display(opening, group, ordinal).alias("displayed"), T.has_formula_prefix(norm, group, ordinal).alias("has_prefix"), T.is_formula(norm).alias("is_formula"))


def sql_wrapper(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(trim({c}), {q(T.WRAPPER)}, '')), ''), trim({c}))"


SAID = "concat_ws(' ', ['verse about', 'Where God says', 'the chapter', 'quran verses on'][turn % 4 + 1], text)"
TRANSLIT = f"""regexp_replace(translate(lower(trim(text)), '{T.ACCENTS_FROM}', '{T.ACCENTS_TO}'), '[^a-z0-9 \\t\\n\\r]', ' ', 'g')"""
for _a, _b in T.LATIN_RULES:
    TRANSLIT = f"regexp_replace({TRANSLIT}, '{_a}', '{_b}', 'g')"
SOUND = sql_replaced(f"regexp_replace(translate(lower(text), '{T.ACCENTS_FROM}', '{T.ACCENTS_TO}'), '[''`]', '', 'g')", T.SOUND_DIGRAPHS)
SOUND_KEY_SQL = sql_squeeze(f"regexp_replace({SOUND}, '[aeiou]', '', 'g')")
NORM = sql_normalize_arabic(ARABIC_TEXT)
FORMULA_NORM = sql_normalize_arabic(q(T.FORMULA))
STEM = "w"
for _p in reversed(("un", "re", "de")):
    STEM = f"CASE WHEN starts_with(w, '{_p}') AND length(w) > {len(_p) + 2} THEN substr(w, {len(_p) + 1}) ELSE {STEM} END"
BACK = "f"
for _s in reversed(("ing", "ed", "en", "s")):
    BACK = f"CASE WHEN ends_with(f, '{_s}') AND length(f) > {len(_s) + 2} THEN left(f, length(f) - {len(_s)}) ELSE {BACK} END"

QUERIES = {
    "b11_normalize_english": normalize_english,
    "b13_paraphrase": paraphrase,
    "b14_content_tokens": content_tokens,
    "b7_b9_translit_keys": normalize_translit,
    "b1_b6_b8_arabic_keys": arabic_keys,
    "b3_b5_opening_formula": arabic_formula,
    "b12_intent_wrapper": intent_wrapper,
    "b19_b20_ngrams": char_ngrams,
    "b18_stem_roots": stem_roots,
    "b17_token_variants": token_variants,
    "b22_b25_script_and_clamp": detect_script,
    "b29_content_hash": content_hash,
    "b27_html_text": html_text,
    "b28_keys": keys,
    "b32_media_url": media_url,
    "b33_fingerprint": fingerprint,
    "b30_highlight": highlight,
    "b31_mark_tokens": mark_tokens,
    "b34_normalize_records": normalize_records,
}

SQL = {
    "b11_normalize_english": f"SELECT doc_id, {ENGLISH_SQL} AS norm FROM documents",
    "b13_paraphrase": f"SELECT doc_id, {sql_replaced(ENGLISH_SQL, T.PARAPHRASES)} AS hinted FROM documents",
    "b14_content_tokens": f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens, CAST(len({sql_tokens('text', True)}) AS BIGINT) AS n_query_tokens FROM documents",
    "b7_b9_translit_keys": f"SELECT doc_id, {sql_squeeze(TRANSLIT)} AS translit, {SOUND_KEY_SQL} AS sound FROM documents",
    "b1_b6_b8_arabic_keys": f"""SELECT doc_id, {NORM} AS norm, lower({sql_squeeze(f"regexp_replace(translate({NORM}, {q(T.SOUNDS_FROM)}, {q(T.SOUNDS_TO)}), '[aeiou]', '', 'g')")}) AS sound,
      CASE WHEN doc_id % 7 = 0 THEN 'given' ELSE {sql_squeeze(f"regexp_replace(translate({sql_replaced(ARABIC_TEXT, T.LATIN_PAIRS)}, '{T.LATIN_FROM}', '{T.LATIN_TO}'), '[^a-z ]', '', 'g')")} END AS latin,
      regexp_replace({ARABIC_TEXT}, {q(T.MARKS)}, '', 'g') AS unmarked FROM documents""",
    "b3_b5_opening_formula": f"""WITH o AS (SELECT doc_id, doc_id % 3 AS ordinal, doc_id % 12 AS grp, {FORMULA_NORM} AS f,
        CASE doc_id % 4 WHEN 0 THEN '{T.FORMULA} ' || {ARABIC_TEXT} WHEN 1 THEN '{T.FORMULA}' ELSE {ARABIC_TEXT} END AS o,
        {sql_normalize_arabic(f"CASE doc_id % 4 WHEN 0 THEN '{T.FORMULA} ' || translate(lower(text), '{SPELL_FROM}', '{SPELL_TO}') WHEN 1 THEN '{T.FORMULA}' ELSE translate(lower(text), '{SPELL_FROM}', '{SPELL_TO}') END")} AS n FROM documents)
      SELECT doc_id, CASE WHEN grp IN (1, 9) OR ordinal <> 1 THEN n WHEN n = f THEN '' WHEN starts_with(n, f || ' ') THEN trim(substr(n, length(f) + 1))
        WHEN starts_with(n, f) AND trim(substr(n, length(f) + 1)) <> '' THEN trim(substr(n, length(f) + 1)) ELSE n END AS searched,
        CASE WHEN grp IN (1, 9) OR ordinal <> 1 OR trim(regexp_replace(o, {q(T.FORMULA_IN_MARKS)}, '')) = '' THEN o ELSE trim(regexp_replace(o, {q(T.FORMULA_IN_MARKS)}, '')) END AS displayed,
        grp NOT IN (1, 9) AND ordinal = 1 AND starts_with(n, f) AS has_prefix, starts_with(n, f) AND length(trim(substr(n, length(f) + 1))) <= 2 AS is_formula FROM o""",
    "b12_intent_wrapper": f"SELECT conv_id, turn, {sql_wrapper(SAID)} AS concept FROM conversations WHERE role = 'user'",
    "b19_b20_ngrams": """WITH t AS (SELECT p_partkey, p_name, replace(p_name, ' ', '') AS s, string_split(p_name, ' ') AS w FROM part)
      SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3)), lambda g: g <> ''))), '|') AS grams,
        array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs FROM t""",
    "b18_stem_roots": f"""WITH w AS (SELECT doc_id, unnest(string_split({ENGLISH_SQL}, ' ')) AS w, generate_subscripts(string_split({ENGLISH_SQL}, ' '), 1) AS i FROM documents),
      f AS (SELECT doc_id, i, {STEM} AS f FROM w WHERE length(w) >= 3), r AS (SELECT doc_id, i, left({BACK}, 3) AS root FROM f),
      u AS (SELECT doc_id, root, min(i) AS i FROM r WHERE length(root) >= 2 GROUP BY 1, 2)
      SELECT d.doc_id, coalesce(string_agg(root, ' ' ORDER BY i), '') AS roots FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY d.doc_id""",
    "b17_token_variants": f"""WITH t AS (SELECT unnest(string_split({NORM}, ' ')) AS t FROM documents), c AS (SELECT t, count(*) AS n FROM t WHERE t <> '' GROUP BY 1)
      SELECT t AS token, n, array_to_string(list_sort(list_distinct(list_filter([t, CASE WHEN length(t) > 3 AND starts_with(t, 'ال') THEN substr(t, 3) END,
        CASE WHEN length(t) >= 4 AND ends_with(t, 'اع') THEN left(t, length(t) - 2) || 'ع' END,
        CASE WHEN length(t) >= 3 AND ends_with(t, 'ع') AND NOT ends_with(t, 'اع') THEN left(t, length(t) - 1) || 'اع' END,
        CASE WHEN length(t) >= 4 AND (ends_with(t, 'ات') OR ends_with(t, 'ين') OR ends_with(t, 'ون')) THEN left(t, length(t) - 2) END], lambda x: x IS NOT NULL))), ' ') AS variants FROM c""",
    "b22_b25_script_and_clamp": f"""SELECT doc_id, CASE WHEN len(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN {ARABIC_TEXT} ELSE text END, '[؀-ۿ]')) > length(text) * 0.3 THEN 'arabic' ELSE 'latin' END AS script,
        length(left(trim(text), 500)) AS clamped FROM documents""",
    "b29_content_hash": "SELECT doc_id, sha256(text) AS hash, length(text) AS chars FROM documents",
    "b27_html_text": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br[ ]*/?>|</(p|li|blockquote)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS plain FROM pages""",
    "b28_keys": "SELECT l_orderkey, l_linenumber, (l_orderkey % 130) || ':' || l_linenumber AS key, CASE WHEN v THEN CAST(l_orderkey % 130 AS INT) END AS group_no, CASE WHEN v THEN l_linenumber END AS ordinal, v AS valid FROM (SELECT *, l_orderkey % 130 BETWEEN 1 AND 114 AND l_linenumber >= 1 AS v FROM lineitem)",
    "b32_media_url": """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey ELSE 1 END AS v, lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.mp3' AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
      SELECT l_orderkey, l_linenumber, 'https://media.example/' || v || '/' || f AS url, CASE WHEN v <> 1 THEN 'https://media.example/1/' || f END AS fallback FROM v""",
    "b33_fingerprint": "WITH c AS (SELECT p_partkey, i, (ascii(substr(p_name, i + 1, 1)) % 32) / 32.0::DOUBLE AS x FROM part, range(0, 64) r(i) WHERE i < length(p_name)), s AS (SELECT p_partkey, "
    + ", ".join(f"coalesce(sum(x) FILTER (WHERE i % 13 = {k}), 0) AS s{k}" for k in range(13))
    + " FROM c GROUP BY 1), n AS (SELECT *, sqrt("
    + " + ".join(f"s{k} * s{k}" for k in range(13))
    + ") AS n FROM s) SELECT p_partkey, "
    + ", ".join(f"round(s{k} / n, 6) AS v{k}" for k in range(13))
    + " FROM n",
    "b30_highlight": f"""WITH b AS (SELECT item_id, list_filter({sql_tokens('text', True)}, lambda w, i: list_position({sql_tokens('text', True)}, w) = i) AS terms FROM benchmark),
      h AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
      r AS (SELECT item_id, arg_min(term, (df, term)) AS term FROM (SELECT item_id, unnest(terms) AS term FROM b) JOIN d USING (term) GROUP BY 1)
      SELECT item_id, doc_id, regexp_replace(lower(text), '(' || array_to_string(terms, '|') || ')', '[\\1]', 'g') AS marked FROM r JOIN h USING (term) JOIN b USING (item_id) JOIN documents USING (doc_id)""",
    "b31_mark_tokens": """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.,;:!?]+|[^.,;:!?]+')) AS t FROM documents)
      SELECT doc_id, CASE WHEN regexp_matches(t, '^[.!?]+$') THEN 'stop' WHEN regexp_matches(t, '^[,;:]+$') THEN 'pause' WHEN regexp_matches(t, '^[.,;:!?]') THEN 'mixed' ELSE 'plain' END AS kind, count(*) AS n FROM m GROUP BY 1, 2""",
    "b34_normalize_records": "SELECT doc_id AS ordinal, trim(text) AS body FROM documents WHERE doc_id % 5 <> 0 AND trim(text) <> '' AND NOT (doc_id % 2 = 1 AND doc_id % 9 = 0)",
}
