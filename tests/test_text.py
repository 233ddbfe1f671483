from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.plans.search_queries import clean_html, search_type


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_arabic(spark):
    assert one(spark, T.normalize_arabic(F.lit("بِسْمِ ٱللَّهِ، الرحمـــن"))) == "بسم الله الرحمن"
    assert one(spark, T.is_formula(T.normalize_arabic(F.lit(T.FORMULA))))
    norm = T.normalize_arabic(F.lit(T.FORMULA + " الم"))
    assert one(spark, T.strip_formula_for_search(norm, F.lit(2), F.lit(1))) == "الم"
    for group, ordinal in ((1, 1), (9, 1), (2, 2)):
        assert one(spark, T.strip_formula_for_search(norm, F.lit(group), F.lit(ordinal))).startswith("بسم")


def test_latin(spark):
    assert one(spark, T.normalize_english(F.lit("  It's  ÉTÉ, 42! "))) == "it's t 42"
    assert one(spark, T.normalize_translit(F.lit("al Rahmaan"))) == "rahman"
    assert one(spark, T.strip_intent_wrapper(F.lit("The verse about patience"))) == "patience"
    assert one(spark, T.strip_intent_wrapper(F.lit("verse about"))) == "verse about"
    assert one(spark, T.char_ngrams(F.lit("a b"))) == ["ab"] and one(spark, T.char_ngrams(F.lit(""))) == []
    assert one(spark, T.parse_key(F.lit("2:5")))["ordinal"] == 5 and one(spark, T.parse_key(F.lit("115:1"))) is None
    assert one(spark, T.html_to_text(F.lit("<p>a <b>b</b></p><p>c</p>"))) == "a b\nc"


def test_word_lists_and_kinds_are_those_of_the_blueprint(spark):
    tokens = lambda t, query=False: one(spark, T.content_tokens(F.lit(t), query))
    assert tokens("They were whom which had been shown how the verse about mercy says so") == ["shown", "verse", "about", "mercy", "says"]
    assert tokens("verse about mercy that Allah says in the Quran", True) == ["mercy"]
    assert one(spark, T.normalize_translit(F.lit("al-Khaaliq  wash-shams"))) == "haliq was sams"
    assert one(spark, T.normalize_translit(F.lit("ar rahmaan"))) == "rahman"
    kinds = {"qul huwa allahu ahad": "transliteration", "he told them of it": "english", "the soul": "english", "zz": "english", "wa la taqrabu": "transliteration", "mountain": "english", "قل هو": "arabic", "zakat sawm": "transliteration"}
    assert {t: one(spark, search_type(F.lit(t))) for t in kinds} == kinds


def test_joined_letter_forms_are_written_out(spark):
    assert one(spark, T.normalize_arabic(F.lit("ﻻ ﷲ ﺑﺎب"))) == "لا الله باب"


def test_display_formula(spark):
    said = "بِسْمِ ٱللَّهِ ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ".replace("ـ", "")
    shown = lambda t, g, o: one(spark, T.strip_formula_for_display(F.lit(t), F.lit(g), F.lit(o)))
    assert shown(said + " الٓمٓ", 2, 1) == "الٓمٓ" and shown(said, 2, 1) == said
    for g, o in ((1, 1), (9, 1), (2, 2)):
        assert shown(said + " الٓمٓ", g, o) == said + " الٓمٓ"


def test_sound_keys(spark):
    latin = one(spark, T.phonetic_keys(F.lit("Khaliq")))
    assert latin["primary"] == latin["latin"] == "xlq"
    arabic = one(spark, T.phonetic_keys(F.lit("قل هو الله")))
    assert arabic["primary"] == "ql hw llh" and arabic["latin"]


def test_given_transliteration_wins_unless_blank(spark):
    made = lambda given: one(spark, T.prepare_translit(F.lit("نور"), F.lit(given))[1])
    assert made("Noor") == "nur" and made("  ") == made(None) == "nwr"


def test_sanitised_html():
    dirty = '<p onclick="x()">ok</p><script>alert(1)</script><img src=x onerror=y><a href="javascript:z()">go</a> <strong>b</strong> 1 < 2'
    assert clean_html(dirty) == "<p>ok</p>go <strong>b</strong> 1 &lt; 2"
