"""Token counts of a sentencepiece BPE model through a whole-token shortcut.

Offline, from the vocabulary alone: no piece crosses from other characters into a following space mark, so texts fall
apart before each space without changing any merge; and the strings that encode alone as one token are found by encoding
every vocabulary string. Pre-tokens among these count as one directly; only the rest is merged, by the library, once per
distinct pre-token while it stays in the worker's bounded cache.

Null and empty texts have no tokens. Texts of any length are counted whole; repeated rows are counted each. Other columns are
kept as they are, but for one that is named like the new one: it is replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS, LONGEST_CACHED = 500_000, 48
#: With several spaces in a row, the run stays with what follows it.
_RUNS = re.compile(r" +[^ ]+| +$")


class Counter:
    """Counts tokens with the model at `path`; `whole` has the pre-tokens that are one token."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [
            p for i, p in enumerate(pieces)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        ]
        #: Falling apart before spaces is exact under these conditions, which hold or not for the model as a whole.
        self.splits = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
            and self.model.encode("a", out_type=str)[0].startswith(MARK)
            and self.model.normalize(" a  b\tﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}b\tﬁ{MARK}"
        )
        words = [p[1:] for p in plain if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
        #: By pre-token without its first space. A lone space is what it adds to the end of a text.
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words)) if len(ids) == 1}
        self.whole[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.cache = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(ids) for ids in self.model.encode(texts)]
        parts, new = [self._parts(t) for t in texts], set()
        if len(self.cache) > CACHE_WORDS:
            self.cache = dict(self.whole)
        for words in parts:
            new.update(words)
        new = list(new.difference(self.cache))
        known = self.cache
        if any(len(w) > LONGEST_CACHED for w in new):
            known = dict(self.cache)
        if new:
            for w, ids in zip(new, self.model.encode(new)):
                known[w] = len(ids)
                if len(w) <= LONGEST_CACHED:
                    self.cache[w] = len(ids)
        return [sum(map(known.__getitem__, words)) for words in parts]

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            return [w[1:] for w in _RUNS.findall(" " + text)]
        return text.split(" ")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text (bigint, never null)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = counter(model_path)
        for texts in batches:
            yield pd.Series(known.count([t or "" for t in texts]), dtype="int64")

    return df.withColumn(out, count(text))
