"""Table functions: rows from one value, for lateral joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf


@udtf(returnType="line_no int, seq int, str string, x double, y double, w double, h double", useArrow=True)
class TokensFromText:
    """The words of a text laid out on a page, a row each; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for line_no, line in enumerate(text.split("\n") if text is not None else []):
            ahead = 0
            for seq, word in enumerate(line.split(" ")):
                if word:
                    yield line_no, seq, word, 4.5 * ahead, 800.0 - 12 * line_no, max(8.0, 4.5 * len(word)), 10.0
                ahead += len(word) + 1
