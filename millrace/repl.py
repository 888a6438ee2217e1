"""A shell: ``python -m millrace.repl FOLDER``."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from .errors import EngineError
from .session import Connection, connect

HELP = """statements end with ;
.begin     start a transaction
.commit    commit it
.rollback  undo it
.help      this text
.exit      leave (also .quit)"""


def table(columns: list[str], rows: list[tuple]) -> str:
    """Rows as aligned text with a head, and their number."""
    cells = [[str(v) for v in r] for r in rows]
    widths = [max(map(len, c)) for c in zip(columns, *cells, strict=True)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, cells), f"({len(rows)} row(s))"])


class Shell:
    def __init__(self, connection: Connection, out: TextIO = sys.stdout):
        self.connection, self.out = connection, out

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def prompt(self, waiting: bool) -> str:
        return "  ...> " if waiting else "millrace*> " if self.connection.tx else "millrace> "

    def command(self, text: str) -> bool:
        """A command that begins with a dot; False to leave."""
        c = self.connection
        if text in (".exit", ".quit"):
            if c.tx:
                self.say("rolling back open transaction before exit")
            c.close()
            self.say("bye")
            return False
        known = {".begin": (c.begin, "transaction started"), ".commit": (c.commit, "committed"), ".rollback": (c.rollback, "rolled back")}
        if text == ".help":
            self.say(HELP)
        elif text in known:
            try:
                known[text][0]()
                self.say(known[text][1])
            except EngineError as e:
                self.say(f"error: {e}")
        else:
            self.say(f'unknown command "{text}" - type .help')
        return True

    def statement(self, sql: str) -> None:
        try:
            cursor = self.connection.execute(sql)
            if cursor.description is None:
                self.say(f"OK ({cursor.rowcount} row(s) affected)")
            else:
                self.say(table(cursor.columns, cursor.fetchall()))
        except EngineError as e:
            self.say(f"error: {e}")

    def run(self, lines: Iterable[str], show_prompt: bool = True) -> None:
        """Statements over as many lines as it takes to a ``;``."""
        held = ""
        if show_prompt:
            self.out.write(self.prompt(False))
        for raw in lines:
            text = raw.strip()
            if not held and text.startswith("."):
                if not self.command(text):
                    return
            else:
                held = f"{held}\n{text}".strip()
                if held.endswith(";"):
                    if sql := held.rstrip("; \n"):
                        self.statement(sql)
                    held = ""
            if show_prompt:
                self.out.write(self.prompt(bool(held)))
                self.out.flush()
        self.connection.close()


if __name__ == "__main__":
    Shell(connect(sys.argv[1] if len(sys.argv) > 1 else "millrace-data")).run(sys.stdin)
