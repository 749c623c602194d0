"""Latin forms against the transliterator that Spark ships, on whole words of every script that is claimed."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pathlore.functions import text as tx

WORDS = {
    "Greek": "ευρώ αυτό ουρανός Ελλάδα εύκολο αγγλικά άγγελος μπάλα υπόθεση Αθήνα ευχαριστώ αϋπνία ΕΥΡΩΠΗ Άουγκστ λάρυγγας σύγχρονος",
    "Cyrillic": "Привет мир объект подъезд ещё Україна щука Йод Љубљана цирк",
    "Armenian": "Հայաստան որոշ ողջույն ուղիղ ՈՒՐԱԽ", "Hebrew": "שלום עברית ירושלים", "Arabic": "مرحبا العربية محمد السلام", "Georgian": "საქართველო გამარჯობა",
    "kana": "きゃく がっこう こんにちは しんいち コーヒー キャッシュ ファイル パーティー おおきい ずっと つづく じゅんや きっちゃん ミュージック ちょっと シャツ ビョーキ",
    "Han": "产品报告 日本語 模型", "Hangul": "서울 한글 안녕하세요 대한민국 읽다 맑음 값이 있었다",
    "Devanagari": "हिन्दी नमस्ते क्षेत्र भारत संस्कृत दस्तावेज़ अंग्रेज़ी ज्ञान तस्वीरें हिंदी संगीत", "Bengali": "বাংলা নমস্কার", "Tamil": "தமிழ் வணக்கம்", "Thai": "สวัสดี ไทย เอกสาร ไฟล์ แมว",
}


@pytest.fixture(scope="module")
def both(spark):
    """The whole transliterator, folded, and the clusters."""
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin")
    return lambda s: tx._folded(icu.transliterate(s)), tx.latin_clusters(spark)


@pytest.mark.parametrize("script", WORDS)
def test_words_of_each_script(both, script):
    whole, clusters = both
    words = unicodedata.normalize("NFC", WORDS[script]).split()
    assert {w: tx._folded(clusters(w)) for w in words} == {w: whole(w) for w in words}


def test_the_words_named(both):
    _, clusters = both
    assert [clusters(w) for w in ("きゃく", "がっこう", "ευρώ", "αυτό", "हिन्दी", "한글.pdf", "产品报告.pdf", "plain")] == ["kyaku", "gakkou", "euro", "auto", "hindi", "hangeul.pdf", "chan pin bao gao.pdf", "plain"]


def test_random_kana_and_syllables(both):
    """Letters in any order: kana with small letters and long marks, Devanagari signs after consonants, Hangul."""
    whole, clusters = both
    rng = random.Random(2)
    kana = ["か", "き", "し", "ち", "つ", "に", "び", "ぽ", "ん", "あ", "や"]
    made = ["".join(rng.choice(["っ", ""]) + rng.choice(kana) + rng.choice(["", "", "ゃ"]) if (c := rng.random()) < 0.9 else "か" for _ in range(4)) for _ in range(200)]
    made += ["".join(rng.choice("कगतनमस") + rng.choice(["", "ा", "ि", "ी", "े", "्"]) for _ in range(5)) for _ in range(200)]
    made += ["".join(chr(rng.randrange(0xAC00, 0xD7A4)) for _ in range(4)) for _ in range(200)]
    right = sum(tx._folded(clusters(w)) == whole(w) for w in made)
    assert right >= 0.97 * len(made)


def test_columns(spark):
    rows = [("Йод и Ünal",), ("l'été  d'or",), (None,), ("こんにちは 'x'",), ("",)]
    got = [r.l for r in tx.with_latin(spark.createDataFrame(rows, "n string"), "n", "l").orderBy(F.col("n").asc_nulls_first()).collect()]
    assert got == [None, "", "l ete d or", "jod i unal", "kon nichiha x"]
