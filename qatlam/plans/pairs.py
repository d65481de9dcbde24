"""Queries over byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.functions import text as T
from qatlam.operators import bpe as B
from qatlam.plans import fragments as S
from qatlam.sources.tables import table

#: The operator's default; base characters take several hundred of it.
VOCAB_SIZE = 8000


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return B.word_counts(table(spark, d, "documents"))


def word_freq(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def word_freq_topk(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).orderBy(F.desc("n"), "word").limit(100)


def word_freq_lower(spark: SparkSession, d: str) -> DataFrame:
    """The counts a trainer of lower-cased text starts from."""
    return B.word_counts(table(spark, d, "documents"), lowercase=True)


def pre_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pre-tokens of each document, blanks included."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.pre_tokens("text", True).alias("p")).select("doc_id", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x.rlike(f"^[{T._S}]"))).alias("blanks"))


def base_chars(spark: SparkSession, d: str) -> DataFrame:
    return B.base_characters(_counts(spark, d))


def char_ids(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered_characters(_counts(spark, d))


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.pair_counts(B.split_words(_counts(spark, d)))


def best_pair(spark: SparkSession, d: str) -> DataFrame:
    return B.best_pair(B.pair_counts(B.split_words(_counts(spark, d))))


def merged_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """The pair counts after one merge, of a and n."""
    split = B.split_words(_counts(spark, d))
    return B.pair_counts(split.withColumn("pieces", B.merge_pieces(F.col("pieces"), "a", "n")))


def _model(spark: SparkSession, d: str) -> B.Model:
    return B.train(table(spark, d, "documents"), VOCAB_SIZE)


def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).merge_table(spark)


def bpe_train_plain(spark: SparkSession, d: str) -> DataFrame:
    """A model of lower-cased words and marks with the special tokens of another family."""
    model = B.train(table(spark, d, "documents"), VOCAB_SIZE, lowercase=True, plain=True, specials=["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"])
    return model.vocab_table(spark)


def plain_word_freq(spark: SparkSession, d: str) -> DataFrame:
    """The counts a trainer of lower-cased words and marks starts from."""
    return B.word_counts(table(spark, d, "documents"), lowercase=True, plain=True)


def bpe_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Every pre-token of the documents with its pieces."""
    found = B.tokenize(table(spark, d, "documents"), _model(spark, d))
    return found.select("doc_id", "pos", "word", F.array_join("pieces", " ").alias("pieces"))


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document, with its beginning and end."""
    ids = B.encode(table(spark, d, "documents"), _model(spark, d), add_bos=True, add_eos=True)
    return ids.select("doc_id", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def bpe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every document as it reads back from its ids: without underscores, which no pre-token has, and blanks other than the space, which the model doesn't know."""
    model = _model(spark, d)
    return B.decode(B.encode(table(spark, d, "documents"), model), model.vocab_table(spark))


QUERIES = {
    q.__name__: q
    for q in (word_freq, word_freq_topk, word_freq_lower, plain_word_freq, pre_token_counts, base_chars, char_ids, pair_counts, best_pair, merged_pair_counts, bpe_train, bpe_train_plain, bpe_tokenize, bpe_encode, bpe_decode)
}

_C = f"counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.pre_tokens('text')}) AS word FROM documents WHERE text <> '') GROUP BY word)"
_CHARS = "chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM counts UNION SELECT ' ')"
_PAIRS = """pairs AS (SELECT p[i] AS "left", p[i + 1] AS "right", n FROM (SELECT p, n, unnest(range(1, len(p))) AS i FROM split)),
    summed AS (SELECT "left", "right", sum(n)::BIGINT AS n FROM pairs GROUP BY ALL)"""
_SPLIT = f"{_C}, split AS (SELECT string_split(word, '') AS p, n FROM counts)"
_SPECIALS = ", ".join(f"(0, {i}, {S.quoted(t)})" for t, i in B.SPECIALS.items())

# the classes of the plain tokens as SQL's expressions have them: letters and the letter-like, which Alphabetic is
_ALNUM = r"\p{L}\p{M}\p{Nl}\p{Nd}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}\x{200c}\x{200d}"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
PLAIN = f"[{_ALNUM}]+|[{_PUNCT}]|[^{_ALNUM}{_PUNCT}{S.C.SPACE}]+"

SQL = {
    "word_freq": f"WITH {_C} SELECT word, n FROM counts",
    "word_freq_topk": f"WITH {_C} SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 100",
    "word_freq_lower": f"SELECT word, count(*) AS n FROM (SELECT unnest({S.pre_tokens('lower(text)')}) AS word FROM documents WHERE text <> '') GROUP BY word",
    "plain_word_freq": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {S.quoted(PLAIN)})) AS word FROM documents WHERE text <> '') GROUP BY word",
    "bpe_decode": f"SELECT doc_id, coalesce(regexp_replace({S.apostrophes('text')}, '_|[\\x09-\\x0d\\x1c-\\x1f{S.C.SPACE.replace(chr(92) + 'x09-' + chr(92) + 'x0d' + chr(92) + 'x1c-' + chr(92) + 'x20', '')}]', '', 'g'), '') AS text FROM documents",
    "pre_token_counts": f"""SELECT doc_id, len(p)::INTEGER AS n, len(list_filter(p, lambda x: regexp_matches(x, '^[{S.C.SPACE}]')))::INTEGER AS blanks
        FROM (SELECT doc_id, {S.pre_tokens('text', True)} AS p FROM documents WHERE text IS NOT NULL)""",
    "base_chars": f"WITH {_C}, {_CHARS} SELECT ch FROM chars",
    "char_ids": f"""WITH {_C}, {_CHARS}, a AS (SELECT * FROM (VALUES {_SPECIALS}) v(section, nth_in, token) UNION ALL SELECT 1, 0, ch FROM chars)
        SELECT token, (row_number() OVER (ORDER BY section, nth_in, token) - 1)::INTEGER AS id FROM a""",
    "pair_counts": f'WITH {_SPLIT}, {_PAIRS} SELECT "left", "right", n FROM summed',
    "best_pair": f'WITH {_SPLIT}, {_PAIRS} SELECT "left", "right", n FROM summed ORDER BY n DESC, "left", "right" LIMIT 1',
    "merged_pair_counts": f"""WITH {_C}, split AS (SELECT list_transform(string_split(replace(word, 'an', chr(57344)), ''), lambda x: replace(x, chr(57344), 'an')) AS p, n FROM counts),
        {_PAIRS} SELECT "left", "right", n FROM summed""",
}
