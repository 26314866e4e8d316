"""``python -m tidewater.shell [database]``: statements and commands from standard input."""

from __future__ import annotations

import sys

from .errors import EngineError
from .plans.parser import split_script
from .session import Engine, Result

HELP = """statements end in ;
\\tables      names of the tables
\\checkpoint  rewrite tables in few sorted files
\\crash       end at once, leaving what isn't committed
\\help        this text
\\q, \\quit    end"""


def table_text(columns: list[str], rows: list[tuple]) -> str:
    cells = [[str(c) for c in columns], *([str(v) for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, width)) + "|"
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule, f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])


def result_text(result: Result) -> str:
    return result.message if result.df is None else table_text(result.columns, result.rows())


class Shell:
    def __init__(self, engine: Engine, write=print) -> None:
        self.engine, self.session, self.write, self._text = engine, engine.session(), write, ""

    def command(self, line: str) -> bool:
        """A backslash command; False ends the shell."""
        if line in ("\\q", "\\quit"):
            return False
        if line == "\\help":
            self.write(HELP)
        elif line == "\\tables":
            for row in self.engine.list_tables().collect():
                self.write(row[0])
        elif line == "\\checkpoint":
            self.write(self.engine.checkpoint())
        elif line == "\\crash":
            raise SystemExit(1)
        else:
            self.write(f"unknown command: {line}")
        return True

    def statement(self, text: str) -> None:
        try:
            self.write(result_text(self.session.execute(text)))
        except Exception as error:  # whatever goes wrong in a statement, the shell goes on
            self.write(f"error: {error}" if isinstance(error, EngineError) else f"error: {type(error).__name__}: {str(error).partition(chr(10))[0]}")

    def feed(self, line: str) -> bool:
        """One line of input; False ends the shell."""
        if not self._text.strip() and line.strip().startswith("\\"):
            self._text = ""
            return self.command(line.strip())
        self._text += line.rstrip("\n") + "\n"
        if ";" in line:
            *done, rest = self._split(self._text)
            for s in done:
                self.statement(s)
            self._text = rest
        return True

    @staticmethod
    def _split(text: str) -> list[str]:
        """Whole statements and what comes after the last semicolon."""
        parts = split_script(text + "\n x")  # the mark joins the last part, if that isn't closed
        last = parts.pop().removesuffix("x").rstrip()
        return [*parts, last]

    def run(self, lines) -> None:
        if any(vars(self.engine.recovery_report).values()):
            r = self.engine.recovery_report
            self.write(f"recovery: {r.committed} committed, {r.rolled_back} rolled back, {r.redone} redone, {r.undone} undone")
        for line in lines:
            if not self.feed(line):
                break
        if self._text.strip():
            for s in split_script(self._text):
                self.statement(s)
        if self.session.txn:
            self.session.rollback()
        self.engine.checkpoint()


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidewater").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    Shell(Engine(spark, sys.argv[1] if len(sys.argv) > 1 else "tidewater.db")).run(sys.stdin)


if __name__ == "__main__":
    main()
