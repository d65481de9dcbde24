"""Train a byte-pair model on a text file, one text a line: python -m qatlam.train_bpe --corpus FILE --output FILE."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from qatlam.operators.bpe import train

#: The special tokens of the lower-casing trainer.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--corpus", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--vocab_size", type=int, default=32_000)
    parser.add_argument("--keep-case", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    texts = spark.read.text(args.corpus).select(F.col("value").alias("text"))
    train(texts, args.vocab_size, lowercase=not args.keep_case, plain=True, specials=SPECIALS).save(args.output)


if __name__ == "__main__":
    main()
