"""Operator 1: token counts with a whole-token shortcut.

The vocabulary strings that encode alone as one token are found once, on the
driver, with the library itself. Pre-tokens of the texts that are among them count
one; only the others are merged by the library, each distinct one once per task
cache. Texts with characters outside Latin script or with something that may be a
special string go to the library whole, as its splitting rules there depend on its
Unicode tables.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids give a
row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import prepare

SPACE = r" \t-\r\x85\xa0"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose classes are not spelled out above, and the start of special strings.
FOREIGN = re.compile("[^\\x00-ɏ]|<\\|")
#: The splitting rule of the lower-case vocabulary; its branches differ in the first character,
#: save for the apostrophe.
WORDS = re.compile(f"[{LETTER}]+|[{NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{LETTER}{NUMBER}]+")
#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE = 900_000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    tok = load(path)
    ends = sorted(v for v in tok.get_vocab() if v.endswith("</w>"))
    byte_of = _byte_alphabet()
    texts = []
    for v in ends:
        try:
            texts.append(bytes(byte_of[c] for c in v[:-4]).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    texts = [t for t in texts if not FOREIGN.search(t) and WORDS.fullmatch(t)]
    found = tok.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, found, strict=True) if len(e) == 1]


def _byte_alphabet() -> dict[str, int]:
    # Byte-level vocabularies write printable bytes as themselves and the rest as
    # the characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookup_all(split: list[list[str]], known: dict, learn, most: int | None = None) -> list[list]:
    """The known value of every piece; `learn` is called with the unknown ones, once.
    Beyond CACHE pieces, or `most` if fewer, the older half stays, as frequent pieces come early."""
    most = CACHE if most is None else min(most, CACHE)
    if len(known) > most:
        older = dict(islice(known.items(), most // 2))
        known.clear()
        known.update(older)
    out = [list(map(known.get, pieces)) for pieces in split]
    # Nearly every text has a new piece, so only the gaps are looked up again.
    gaps = [(pieces, values, [j for j, v in enumerate(values) if v is None])
            for pieces, values in zip(split, out, strict=True) if None in values]
    new = {pieces[j] for pieces, _, at in gaps for j in at}
    if new:
        learn(list(new))
        for pieces, values, at in gaps:
            for j in at:
                values[j] = known[pieces[j]]
    return out


class Counter:
    def __init__(self, path: str, singles: list[str]):
        self.tok, self.known = load(path), dict.fromkeys(singles, 1)

    def learn(self, words: list[str]) -> None:
        found = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        n = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        self.known.update(zip(words, n.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        lows = [t.lower() for t in texts]
        plain = [i for i, t in enumerate(lows)
                 if (t.isascii() and "<|" not in t) or not FOREIGN.search(t)]
        found = lookup_all([WORDS.findall(lows[i]) for i in plain], self.known, self.learn)
        got = dict(zip(plain, map(sum, found), strict=True))
        return [got[i] if i in got else
                len(self.tok.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, *, path: str | None = None, limit: int = 2048,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens of the whole text and whether these exceed
    `limit`. `path` is a tokenizer file with the splitting rule of WORDS."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or default_path("word_bpe_49k.json")
    singles = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, singles.value)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = pa.array(_COUNTERS[path].counts(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), n,
                 pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
