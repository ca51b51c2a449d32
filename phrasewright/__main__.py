"""python -m phrasewright [DICTIONARY.tsv] TEXT...: tags a text, one line a tag.

With DATA set, every CSV of that folder is the dictionary and all arguments are the text; without
a text it is read from standard input.
"""

from __future__ import annotations

import sys


def main(args: list[str], stdin=sys.stdin, stdout=sys.stdout, stderr=sys.stderr) -> int:
    from pyspark.sql import SparkSession

    from .operators.formats import tsv_lines
    from .operators.tagger import Tagger
    from .sources.dictionaries import data_folder

    if not data_folder() and not args:
        print(__doc__, file=stderr)
        return 2
    spark = SparkSession.builder.appName("phrasewright").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if data_folder():
            tagger = Tagger.from_env(spark)
        else:
            tagger, args = Tagger.from_tsv_file(spark, args[0]), args[1:]
        print(f"{len(tagger)} keys, {tagger.record_count()} records", file=stderr)
    except Exception as e:  # whatever a store says about a path
        print(f"the dictionary can't be read: {e}", file=stderr)
        return 1
    text = " ".join(args) if args else stdin.read()
    tags = tagger.tag(spark.createDataFrame([(0, text)], "key int, text string"), ["key"])
    for row in tsv_lines(tags, ["key"]).orderBy("seq").collect():
        print(row["line"], file=stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
