"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus (once for every
65,536 blocks), joined to the documents' pre-token frequencies by blocks, and summed."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import pretokens

def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splitter(path: str) -> Callable[[list], list[list[str]]]:
    """Pre-tokens of texts as the byte-level tokenizer of ``path`` makes them; special strings stay whole. Where
    libraries of different Unicode versions may class a character differently, the tokenizer's own splitter is asked."""
    held: list = []

    def split(texts: list) -> list[list[str]]:
        if not held:
            import regex

            tokenizer = load_tokenizer(path)
            special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
            pre = tokenizer.pre_tokenizer
            held.extend([regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None, pretokens.finder(pretokens.PATTERN, lambda t: [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)])])
        special, find = held
        out = []
        for text in texts:
            words: list[str] = []
            for k, part in enumerate(special.split(text) if text and special else [text or ""]):
                words += [part] if k % 2 else find(part)
            out.append(words)
        return out

    return split


def _pieces(path: str):
    """Rows of a word stand together: its pieces are counted at the first and held for the rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, before, n = load_tokenizer(path), None, 0
        for b in batches:
            words = b.column(0).to_pylist()
            new = [k for k, w in enumerate(words) if w != (words[k - 1] if k else before)]
            lengths = [len(e.ids) for e in tokenizer.encode_batch([words[k] for k in new], add_special_tokens=False)]
            ends = [*new[1:], len(words)]
            lead = new[0] if new else len(words)
            out = [n] * lead + [x for x, a, e in zip(lengths, new, ends) for _ in range(e - a)]
            if words:
                before, n = words[-1], out[-1]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.int32())], ["block", "place", "pieces"])

    return count


def _sums(block: dict[str, np.ndarray], found: dict[str, np.ndarray]) -> pa.Table:
    known = found["pieces"].astype(np.int64)
    # a document without words sums to nothing
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(known[block["flat"]])])
    ends = np.cumsum(block["lens"])
    return pa.table({"id": pa.array(block["ids"], mask=block["known"] == 0), "n_bytes": pa.array(block["sizes"]), "n_tokens": pa.array(upto[ends] - upto[ends - block["lens"]])})


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """id, n_bytes (of UTF-8) and n_tokens of every row, as the tokenizers library counts them without begin, end or
    added special tokens. Null and empty texts have none; repeated rows come out as often; an empty table gives no rows;
    other columns aren't read."""
    blocks, buckets = B.build_blocks(docs, splitter(tokenizer_path), id_col, text_col, block_bytes=block_bytes)
    rows = B.word_rows(blocks)
    near = B.salted(rows, B.salts(blocks)).select("word", "block", "place", "salt").repartition("word", "salt").sortWithinPartitions("word")
    found = near.mapInArrow(_pieces(tokenizer_path), "block long, place int, pieces int")
    return B.by_block(blocks, buckets, found, _sums, "id long, n_bytes long, n_tokens long")
