"""Tokenizers in a folder: settings, dictionary, byte-pair model and vocabulary, as files other tools can read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from qatlam.operators.bpe import Model
from qatlam.operators.vocab import build_vocab
from qatlam.session import file_exists, read_text, write_text
from qatlam.sources.lexicon import read_stems, write_stems


@dataclass
class Settings:
    max_depth: int = 15
    use_trie: bool = True
    cache_size: int = 50_000  # kept for other readers; distinct words are analysed once here
    has_bpe: bool = False
    version: str = "0.1.0"


def save_vocab(vocab: DataFrame, path: str) -> dict[str, int]:
    """The vocabulary (token, id) as one JSON object, in the order of the ids. A vocabulary is of a dictionary's size."""
    ids = {row["token"]: row["id"] for row in vocab.orderBy("id").toLocalIterator()}
    write_text(path, [json.dumps(ids, ensure_ascii=False, indent=2)])
    return ids


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary file."""
    return spark.createDataFrame(list(json.loads(read_text(path)).items()), "token string, id int")


def save_tokenizer(folder: str, stems: DataFrame, model: Model | None = None, settings: Settings | None = None) -> None:
    """config.json, dictionary.txt, vocab.json and, with a model, bpe_model.json."""
    target = folder.rstrip("/")
    kept = asdict(settings or Settings()) | {"has_bpe": model is not None}
    write_text(f"{target}/config.json", [json.dumps(kept, indent=2)])
    write_stems(stems, f"{target}/dictionary.txt")
    if model is not None:
        model.save(f"{target}/bpe_model.json")
    save_vocab(build_vocab(stems.sparkSession, stems, model=model), f"{target}/vocab.json")


def load_tokenizer(spark: SparkSession, folder: str) -> tuple[DataFrame, Model | None, Settings]:
    """The stems, the model if there is one, and the settings. The saved dictionary is all of it: nothing is added."""
    source = folder.rstrip("/")
    known = Settings.__dataclass_fields__
    settings = Settings(**{k: v for k, v in json.loads(read_text(f"{source}/config.json")).items() if k in known})
    path = f"{source}/bpe_model.json"
    model = Model.load(path) if settings.has_bpe and file_exists(path) else None
    return read_stems(spark, f"{source}/dictionary.txt"), model, settings
