"""``python -m tessera.cli``: an interactive prompt over a local engine or a server, or the server itself."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator


def ends(text: str) -> bool:
    """Whether a text has a semicolon outside of strings."""
    quote = ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            return True
    return False


def statements(lines: Iterator[str]) -> Iterator[str]:
    """Statements of an input, which end with a line that has a semicolon outside of strings; ``.quit`` ends it."""
    text = ""
    for line in lines:
        if not text and line.strip() == ".quit":
            return
        text += line
        if ends(text):
            yield text.strip()
            text = ""


def repl(run: Callable[[str], str], source: Iterator[str], out=sys.stdout) -> None:
    for text in statements(source):
        try:
            print(run(text), file=out)
        except Exception as e:  # a prompt outlives any failed statement
            print(f"error: {e}", file=out)


def _prompt() -> Iterator[str]:
    while True:
        try:
            yield input("tessera> ") + "\n"
        except EOFError:
            return


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("mode", choices=["local", "serve", "connect"])
    parser.add_argument("path", nargs="?", help="the database's folder (local, serve)")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=4000)
    o = parser.parse_args(args)
    if o.mode == "connect":
        from tessera.streaming.client import Connection

        with Connection(o.host, o.port) as c:
            repl(lambda s: f"{r} rows affected" if isinstance(r := c.query(s), int) else r.to_text(), _prompt())
        return
    from pyspark.sql import SparkSession

    from tessera.session import Engine

    engine = Engine(SparkSession.builder.appName("tessera").getOrCreate(), o.path)
    if o.mode == "serve":
        from tessera.streaming.server import serve

        serve(engine, o.host, o.port)
    else:
        print('The table "engine_master" lists tables and indexes; ".quit" leaves.')
        repl(lambda s: engine.sql(s).to_text(), _prompt())


if __name__ == "__main__":
    main()
