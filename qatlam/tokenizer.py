"""One object for the whole hybrid tokenizer: a dictionary, affixes and, if trained, byte pairs, over DataFrames of texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from qatlam.operators import analysis, bpe, tokens, vocab
from qatlam.session import file_exists
from qatlam.sources import lexicon, models


class Tokenizer:
    """A tokenizer whose methods take a table of texts (or of words) and return a plan.

    ``stems`` is a table of one column, or a list. The library brings no dictionary of its own.
    """

    def __init__(self, spark: SparkSession, stems: DataFrame | Iterable[str] = (), model: bpe.Model | None = None, settings: models.Settings | None = None):
        self.spark, self.model, self.settings = spark, model, settings or models.Settings()
        self.stems = lexicon.dictionary(self._table(stems))
        self.affixes = analysis.default_affixes(spark, self.settings.use_trie)

    def _table(self, stems: DataFrame | Iterable[str]) -> DataFrame:
        return stems if isinstance(stems, DataFrame) else self.spark.createDataFrame([(s,) for s in stems], "stem string")

    # -------------------------------------------------------------- dictionary and byte pairs
    def load_dictionary(self, source: str = "auto", path: str | None = None, extra: DataFrame | Iterable[str] = (), cache: str | None = None) -> Tokenizer:
        """Add the stems of a file and ``extra`` ones.

        ``source`` is file, hunspell, or auto, which goes by the name's ending, and takes a file that
        isn't there for none. Nothing is downloaded.
        """
        if source not in ("auto", "file", "hunspell"):
            raise ValueError(f"no such source of a dictionary: {source}")
        if path is None and source != "auto":
            raise ValueError("a path is needed")
        if path and (source != "auto" or file_exists(path)):
            hunspell = source == "hunspell" or (source == "auto" and path.endswith(".dic"))
            self.stems = lexicon.add_stems(self.stems, lexicon.read_hunspell(self.spark, path, cache) if hunspell else lexicon.read_stems(self.spark, path))
        self.stems = lexicon.add_stems(self.stems, self._table(extra))
        return self

    def train_bpe(self, texts: DataFrame, vocab_size: int = 8000, min_frequency: int = 2, text: str = "text") -> Tokenizer:
        self.model = bpe.train(texts, vocab_size, min_frequency, text)
        return self

    def load_bpe(self, path: str) -> Tokenizer:
        self.model = bpe.Model.load(path)
        return self

    @property
    def has_bpe(self) -> bool:
        return self.model is not None

    @property
    def dictionary_size(self) -> int:
        return self.stems.count()

    # -------------------------------------------------------------- texts
    def tokenize(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
        """The tokens of every text, see :func:`qatlam.operators.tokens.tokenize`."""
        return tokens.tokenize(texts, self.stems, self.affixes, doc_id, text, max_depth=self.settings.max_depth, model=self.model, **how)

    def tokenize_to_strings(self, texts: DataFrame, style: str = "plus", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        return tokens.token_strings(self.tokenize(texts, doc_id, text), style, doc_id)

    def analyze_text(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, pos, record): every token of every text as a nested record in JSON."""
        return self.tokenize(texts, doc_id, text).select(doc_id, "pos", tokens.token_record().alias("record"))

    def vocabulary(self) -> DataFrame:
        return vocab.build_vocab(self.spark, self.stems, model=self.model)

    def encode(self, texts: DataFrame, style: str = "hybrid", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        return tokens.encode_documents(texts, self.stems, self.affixes, self.vocabulary(), style, doc_id, text, max_depth=self.settings.max_depth, model=self.model)

    def decode(self, encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
        return vocab.decode(encoded, self.vocabulary(), doc_id, ids)

    # -------------------------------------------------------------- words
    def analyze(self, words: DataFrame) -> DataFrame:
        """The analysis of each distinct word (column ``word``, in dictionary spelling)."""
        return analysis.analyze(words, self.stems, self.affixes, self.settings.max_depth)

    def analyze_all(self, words: DataFrame, max_results: int = 5) -> DataFrame:
        return analysis.analyze_all(words, self.stems, self.affixes, max_results, self.settings.max_depth)

    # -------------------------------------------------------------- figures and files
    def stats(self, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        return tokens.token_stats(self.tokenize(texts, doc_id, text), self.stems, self.has_bpe)

    def save(self, folder: str) -> None:
        models.save_tokenizer(folder, self.stems, self.model, self.settings)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Tokenizer:
        stems, model, settings = models.load_tokenizer(spark, folder)
        return cls(spark, stems, model, settings)


def create_tokenizer(spark: SparkSession, stems: DataFrame | Iterable[str] = (), dictionary: str | None = None, max_depth: int = 15) -> Tokenizer:
    """A tokenizer ready for use, with the stems of a dictionary file if there is one at ``dictionary``."""
    made = Tokenizer(spark, stems, settings=models.Settings(max_depth=max_depth))
    return made.load_dictionary("auto", dictionary) if dictionary else made
