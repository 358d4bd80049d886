"""Command line: `python -m corvidex index collection.tsv /index`, then `python -m corvidex search /index [words]`.

Without words, search asks for a choice (1 all words, 2 any word, 3 end) and a line of words until it is told to
end or the input ends.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator

from corvidex.operators import index, search
from corvidex.session import session
from corvidex.sources import documents

CHOICES = {"1": "and", "2": "or", "3": None}


def asked() -> Iterator[tuple[str, str]]:
    """(mode, words) as typed; other choices than 1 to 3 and lines without a term are asked for again."""
    while True:
        try:
            choice = input("1 all words, 2 any word, 3 end: ").strip()
            if choice not in CHOICES:
                print("Choose 1, 2 or 3.")
                continue
            if (mode := CHOICES[choice]) is None:
                return
            words = input("Words: ")
        except EOFError:
            return
        if (why := search.rejected(words)) is None:
            yield mode, words
        else:
            print(f"That cannot be searched for: {why}.")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvidex", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("tsv")
    build.add_argument("path")
    find = commands.add_parser("search")
    find.add_argument("path")
    find.add_argument("words", nargs="*")
    find.add_argument("--mode", choices=("and", "or"), default="or")
    find.add_argument("-k", type=int, default=search.K)
    chosen = parser.parse_args(args)
    spark = session()
    if chosen.command == "index":
        index.write_index(documents.page_table(documents.read_tsv(spark, chosen.tsv)), chosen.path)
        if rejects := documents.tsv_rejects(spark, chosen.tsv).groupBy("reason").count().orderBy("reason").collect():
            print("Lines left out: " + ", ".join(f"{r['count']} {r.reason}" for r in rejects))
        return
    opened = index.open_index(spark, chosen.path)
    for mode, words in [(chosen.mode, " ".join(chosen.words))] if chosen.words else asked():
        for hit in search.with_content(search.search_index(opened, words, mode, chosen.k), opened.pages).orderBy("rank").collect():
            print(f"{hit.doc_id}\t{hit.score:.6f}\t{hit.content}")


if __name__ == "__main__":
    main()
