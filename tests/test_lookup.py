import pytest

from qatlam.operators import lookup as L
from qatlam.sources import lexicon as X

SUFFIXES = "da dan ga ni ning lar imiz imizda larimizda roq cha".split()
STEMS = "kitob kitobxon kitobxona maktab maktabdosh daftar qalam qalamdon ona ona-vatan o'quvchi g'olib".split()


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def keys(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_affix_table(spark):
    table = X.affixes(spark)
    variants = X.affix_variants(table)
    assert table.count() == 39 and variants.count() == 73 and variants.select("variant").distinct().count() == 66
    order = {v: [r[0] for r in variants.where(f"variant = '{v}'").orderBy("trie_ord").select("affix_id").collect()] for v in ("lar", "da", "di")}
    assert order == {"lar": ["verb_pers_3pl", "pl_lar"], "da": ["part_da", "case_loc"], "di": ["tense_pres_ydi", "tense_past"]}
    assert X.affix_by_id(table, "case_abl").first()["base"] == "dan"


def test_suffixes(spark):
    found = L.find_suffixes(words(spark, "kitoblarimizda", "maktabda", "kitob", "", None), keys(spark, "suffix", SUFFIXES), 9).collect()
    by = {w: sorted((r["suffix"] for r in found if r["word"] == w), key=len, reverse=True) for w in ("kitoblarimizda", "maktabda", "kitob")}
    assert by == {"kitoblarimizda": ["larimizda", "imizda", "da"], "maktabda": ["da"], "kitob": []}
    assert len(found) == 4


def test_prefixes(spark):
    stems = keys(spark, "stem", STEMS)
    assert [r[0] for r in L.words_with_prefix(stems, "kitob").collect()] == ["kitob", "kitobxon", "kitobxona"]
    assert [r[0] for r in L.words_with_prefix(stems, "kitob", 2).collect()] == ["kitob", "kitobxon"]
    assert L.words_with_prefix(stems, "kitob", 0).count() == 0
    assert {r["stem"] for r in L.find_prefixes(words(spark, "kitobxoni"), stems).collect()} == {"kitobxon", "kitob"}
    assert {tuple(r) for r in L.longest_prefix(words(spark, "kitobxoni", "x", None), stems).collect()} == {("kitobxoni", "kitobxon"), ("x", None)}
    assert L.starts_with(stems, "qal") and not L.starts_with(stems, "zzz") and L.starts_with(stems, "")
    assert not L.starts_with(stems.limit(0), "")


def test_membership_keeps_repeats(spark):
    got = L.membership(words(spark, "ona", "ona", "x", None), keys(spark, "stem", STEMS + ["ona"]))
    assert sorted((str(r["word"]), r["found"]) for r in got.collect()) == [("None", False), ("ona", True), ("ona", True), ("x", False)]
    assert L.known_words(words(spark, "ona", "x"), keys(spark, "stem", STEMS)).collect()[0][0] == "ona"
    assert L.unknown_words(words(spark, "ona", "x"), keys(spark, "stem", STEMS)).collect()[0][0] == "x"


def test_clashing_columns(spark):
    df = words(spark, "ona").selectExpr("word", "1 as found", "2 as extra")
    row = L.membership(df, keys(spark, "stem", STEMS)).first()
    assert row["found"] is True and row["extra"] == 2


def test_completions(spark):
    k = keys(spark, "key", ["la", "lan", "lash", "lashtir", "n", "a"])
    got = {(r["match"], r["kind"]) for r in L.suffixes_and_completions(words(spark, "la"), k, 7).collect()}
    assert got == {("a", "suffix"), ("n", "completion"), ("sh", "completion"), ("shtir", "completion")}
    assert {(r["match"], r["kind"]) for r in L.suffixes_and_completions(words(spark, "lan"), k, 7).collect()} == {("lan", "suffix"), ("n", "suffix")}


def test_payloads(spark):
    index = L.insert_keys(spark.createDataFrame([], "key string, payloads array<string>"), spark.createDataFrame([("da", "x"), ("da", "y"), ("ga", "z")], "key string, payload string"))
    assert {r["key"]: r["payloads"] for r in L.get_payloads(spark.createDataFrame([("da",), ("qq",)], "key string"), index).collect()} == {"da": ["x", "y"], "qq": None}


def test_dictionaries(spark, tmp_path):
    f = tmp_path / "d.txt"
    f.write_text("# a comment\nKitob\n\n  O'zbek \nkitob\n", encoding="utf-8")
    stems = X.read_stems(spark, str(f))
    assert {r[0] for r in stems.collect()} == {"kitob", "oʻzbek"}
    more = X.add_stems(stems, keys(spark, "w", ["Yangi", "kitob", None, ""]))
    assert {r[0] for r in more.collect()} == {"kitob", "oʻzbek", "yangi"}
    assert {r[0] for r in X.remove_stems(more, keys(spark, "w", ["KITOB"])).collect()} == {"oʻzbek", "yangi"}
    assert X.new_stems(stems, keys(spark, "w", ["a", "a", "kitob"])).count() == 1
    X.write_stems(more, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text(encoding="utf-8") == "kitob\noʻzbek\nyangi\n"
    assert X.dictionary_stats(more).first().asDict() == {"total_stems": 3, "avg_length": pytest.approx(16 / 3), "min_length": 5, "max_length": 6, "with_apostrophe": 0}
    assert X.dictionary_stats(more.limit(0)).first()["avg_length"] == 0
    with pytest.raises(FileNotFoundError):
        X.read_stems(spark, str(tmp_path / "none.txt"))


def test_hunspell(spark, tmp_path):
    f = tmp_path / "x.dic"
    f.write_text("3\nkitob/AB\nona\n\nG'olib/C\n", encoding="utf-8")
    cache = tmp_path / "cache.txt"
    assert {r[0] for r in X.read_hunspell(spark, str(f), str(cache)).collect()} == {"kitob", "ona", "gʻolib"}
    assert {r[0] for r in X.read_hunspell(spark, "/nowhere", str(cache)).collect()} == {"kitob", "ona", "gʻolib"}
    with pytest.raises(ConnectionError):
        X.read_hunspell(spark, "/nowhere")
