import pytest

from qatlam.operators import analysis as A
from qatlam.sources import lexicon as X

STEMS = (
    "maktab ishla kel dars qishloq o'qi yoz bog' tog' kitob kod funksiya siz fayl o'qit yurak tilak shahar singil burun o'g'il bag'ir ko'ngil qorin bo'yin og'iz o'rtoq tayoq buloq quloq oyoq".split()
)
# word: root, affixes from left to right, known, confidence
GOLDEN = {
    "maktablarimizda": ("maktab", ["pl_lar", "poss_1pl", "case_loc"], True, 0.915),
    "ishlaydigan": ("ishla", ["partic_digan"], True, 0.9),
    "keldi": ("kel", ["tense_pres_ydi"], True, 0.8),
    "darsliklar": ("dars", ["deriv_lik", "pl_lar"], True, 0.86),
    "qishlogʻimiz": ("qishloq", ["poss_1pl"], True, 0.95),
    "qishlogʻimizdan": ("qishloq", ["poss_1pl", "case_abl"], True, 0.955),
    "oʻqiymiz": ("oʻqi", ["tense_fut_a", "verb_pers_1pl"], True, 0.85),
    "pythonda": ("python", ["case_loc"], False, 0.455),
    "pythonistlar": ("pythonist", ["pl_lar"], False, 0.46),
    "yuragi": ("yurak", ["poss_3sg"], True, 0.9), "tilagim": ("tilak", ["poss_1sg"], True, 0.9), "shahri": ("shahar", ["poss_3sg"], True, 0.95),
    "singlim": ("singil", ["poss_1sg"], True, 0.95), "burni": ("burun", ["poss_3sg"], True, 0.9), "oʻgʻli": ("oʻgʻil", ["poss_3sg"], True, 0.95),
    "tayogʻi": ("tayoq", ["poss_3sg"], True, 0.9), "bulogʻi": ("buloq", ["poss_3sg"], True, 0.9), "oyogʻi": ("oyoq", ["poss_3sg"], True, 0.85),
    "bogʻi": ("bogʻ", ["poss_3sg"], True, 0.85), "sizga": ("siz", ["case_dat"], True, 0.805), "xyz": ("xyz", [], False, 0.0),
}


@pytest.fixture(scope="module")
def stems(spark):
    return X.dictionary(spark.createDataFrame([(s,) for s in STEMS], "stem string"))


@pytest.fixture(scope="module")
def affixes(spark):
    return A.default_affixes(spark)


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_golden(spark, stems, affixes):
    got = {r["word"]: r for r in A.analyze(words(spark, *GOLDEN, *GOLDEN, None), stems, affixes).collect()}
    assert got.keys() == GOLDEN.keys()
    for w, (root, ids, found, confidence) in GOLDEN.items():
        r = got[w]
        assert (r["root"], [s["affix_id"] for s in r["suffixes"]], r["is_found"], r["is_compound"]) == (root, ids, found, False), w
        assert r["confidence"] == pytest.approx(confidence, abs=1e-9), w


def test_linear_order(spark, stems):
    r = A.analyze(words(spark, "keldi"), stems, A.default_affixes(spark, use_trie=False)).first()
    assert r["suffixes"][0]["affix_id"] == "tense_past"


def brute_force(word, stems, rows, k):
    """The search as a plain recursion: the first 2k hits by path, best first; else all unknown roots."""
    hits, unknown = [], []

    def fits(stem, text):
        hard = stem[-1:] in ("k", "q")
        return hard if text in A.AFTER_K_OR_Q else not hard if text in A.NOT_AFTER_K_OR_Q else True

    def root_of(rem, depth):
        options = [rem]
        if depth:
            options.append(X.SOUND_CHANGES.get(rem))
            options.append(rem[:-2] + "q" if rem.endswith(("gʻ", "g'")) else None)
            options.append(rem[:-1] + "k" if rem.endswith("g") else None)
        return next((o for o in options if o in stems), None)

    def score(root, path, found):
        s = 0.5 if found else 0.0
        s += min(0.3, len(root) * 0.05)
        s += 0.2 if not path else 0.15 if len(path) <= 2 else 0.1 if len(path) <= 4 else 0.0
        for p in path:
            s += rows[p - 1]["priority"] * 0.001
        return s

    def walk(rem, path, strict):
        if strict and len(hits) < 2 * k:
            root = root_of(rem, len(path))
            if root is not None and (not path or fits(root, rows[path[-1] - 1]["variant"])):
                hits.append((root, path, score(root, path, True)))
        if not strict and 0 < len(path) <= 5:
            unknown.append((rem, path, score(rem, path, False)))
        if len(path) >= (15 if strict else 5):
            return
        for n, r in enumerate(rows, 1):
            rest = rem[: -len(r["variant"])]
            if rem.endswith(r["variant"]) and len(rest) >= 2 and (not strict or fits(rest, r["variant"])):
                if path and (f := rows[path[-1] - 1]["follows"]) is not None and r["category"] not in f:
                    continue
                walk(rest, [*path, n], strict)

    walk(word, [], True)
    if not hits:
        walk(word, [], False)
    return [(root, path) for root, path, _ in sorted(hits or unknown, key=lambda x: -x[2])[:k]], bool(hits)


def test_against_recursion(spark, stems, affixes):
    rows = X.affix_variants(X.affixes(spark)).orderBy("trie_ord").collect()
    tested = [*GOLDEN, "kitoblardagilar", "lalalalalala", "maktabimizdaymisiz", "kodlashtirilmaganlar", "yozgandagimi", "a", "qoqqa"]
    names = {s.replace("'", "ʻ") for s in STEMS}
    for k in (1, 5):
        got = {}
        for r in A.analyze_all(words(spark, *tested), stems, affixes, max_results=k).orderBy("word", "rank").collect():
            got.setdefault(r["word"], []).append((r["root"], [s["affix_id"] for s in r["suffixes"]], r["is_found"]))
        for w in tested:
            expected, found = brute_force(w, names, rows, k)
            assert got.get(w, []) == [(root, [rows[p - 1]["affix_id"] for p in reversed(path)], found) for root, path in expected], (w, k)


def test_empty_inputs(spark, stems, affixes):
    assert A.analyze(words(spark).limit(0), stems, affixes).count() == 0
    assert A.analyze(words(spark, "", "a"), stems.limit(0), affixes).orderBy("word").first()["root"] == ""


def test_record(spark, stems, affixes):
    r = A.analyze(words(spark, "maktabda"), stems, affixes).select(A.analysis_record().alias("r")).first()["r"]
    assert (r["status"], r["suffix_chain"], r["confidence"]) == ("found", "+da(o'rin-payt)", 0.955)
