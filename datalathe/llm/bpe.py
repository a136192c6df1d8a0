"""BPE encoding and decoding in batched merge rounds.

The symbols of many words lie in one flat array. A round looks up every pair
of neighbours by binary search over the sorted pair keys, takes the lowest
rank of each word, and merges the pairs that have it; words without a known
pair leave. Each distinct pre-token of a block is encoded once."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from datalathe.llm.text import (LOWER, Texts, arrow_type, distinct_spans, earlier, gather, later, text_blocks, two_columns,
                                word_spans)

NO_RANK = np.int64(2**62)
#: Kinds of bytes in a normalised word: 1 letter, 2 digit, 3 other printable, 4 needs the library's normalizer.
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[97:123] = 1
KIND[0xC3] = 1
KIND[39] = 4  # an apostrophe may begin an ending such as 's


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    return [rest.get(b, chr(b)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the tokenizers library: BPE over byte characters with a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + ("|".join(map(re.escape, self.special)) or "(?!)") + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        chars = byte_characters()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        # of a repeated pair the last line counts, as in a table that is filled in order
        order = np.lexsort((np.arange(len(keys)), keys))
        final = np.append(keys[order][1:] != keys[order][:-1], True)
        order = order[final]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # A merge may be done everywhere in a word at once if no pair with its symbol ranks before it.
        first_use = np.full(int(max(self.text_of)) + 1, NO_RANK)
        for side in (left, right):
            np.minimum.at(first_use, side[order], order)
        self.one_by_one = first_use[self.made] < self.ranks

    def pieces(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, whose bytes lie in raw one after another: a flat array and where each begins (n + 1)."""
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends[sizes > 0] - 1] = self.last[raw[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [], []
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[1:] == word[:-1])
            rank = np.where(known, self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            lengths = np.diff(np.append(begin, len(symbols)))
            live = np.repeat(lowest < NO_RANK, lengths)
            take = live & (rank == np.repeat(lowest, lengths))
            positions = np.flatnonzero(take)
            if not len(positions):
                break
            # In a run of overlapping pairs every second one is merged, from the left.
            run = np.append(True, positions[1:] != positions[:-1] + 1)
            head = np.maximum.accumulate(np.where(run, positions, 0))
            keep = (positions - head) % 2 == 0
            if self.one_by_one[at[positions]].any():
                again = np.append(False, word[positions][1:] == word[positions][:-1])
                keep &= ~(again & self.one_by_one[at[positions]])
            positions = positions[keep]
            symbols[positions] = self.made[at[positions]]
            gone = np.zeros(len(symbols), bool)
            gone[positions + 1] = True
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
            stay = live & ~gone
            symbols, word = symbols[stay], word[stay]
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(sizes)))))
        return symbols[order].astype(np.uint32), starts

    def split_word(self, word: bytes) -> list[bytes]:
        """Pre-tokens of a word without white space, with the library's own normalizer; special strings stay whole."""
        found: list[bytes] = []
        for part in self.special_pattern.split(word.decode("utf-8", "replace")):
            if part in self.special:
                found.append(part.encode())
            elif part:
                for piece in self.library.normalizer.normalize_str(part).split(" "):
                    found += [p.encode() for p in self.split.findall(piece)]
        return found

    def pre_tokens(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of the pre-tokens of all texts, in order: a buffer of normalised bytes, starts, ends in it, and
        where each text's spans begin (n + 1 values).

        Words of printable ASCII and Latin letters are normalised and split by looking at their bytes; words with
        an apostrophe, a special string or other characters go through split_word one by one."""
        starts, ends, _ = word_spans(texts)
        buf = LOWER[texts.buf]
        lead = buf == 0xC3
        second = earlier(lead)
        buf[second & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
        sign = second & ((buf == 0x97) | (buf == 0xB7))  # multiplication and division signs
        kind = KIND[buf]
        kind[second] = 1
        kind[sign] = 3
        kind[later(sign)] = 3
        odd = (kind == 4) | (second & ((buf < 0x80) | (buf > 0xBF))) | ((buf == 124) & later(buf == 62))
        n_odd = np.concatenate(([0], np.cumsum(odd)))
        plain = n_odd[starts] == n_odd[ends]
        # a pre-token begins where a word begins, where the kind changes, and at each digit
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts[plain]] = 1
        inside[ends[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        new = inside & ((kind != earlier(kind)) | (kind == 2))
        new[starts[plain]] = True
        at = np.flatnonzero(new)
        stop = np.zeros(len(buf) + 1, bool)
        stop[at] = True
        stop[ends[plain]] = True
        until = np.flatnonzero(stop)
        until = until[np.searchsorted(until, at, "right")] if len(at) else at
        where = at
        if not plain.all():
            extra, extra_at, extra_size = [], [], []
            for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True):
                own = self.split_word(texts.buf[a:b].tobytes())
                extra += own
                extra_at += [a] * len(own)
            extra_size = np.fromiter(map(len, extra), np.int64, len(extra))
            extra_end = len(buf) + np.cumsum(extra_size)
            buf = np.concatenate((buf, np.frombuffer(b"".join(extra), np.uint8)))
            where = np.concatenate((at, np.array(extra_at, np.int64)))
            order = np.argsort(where, kind="stable")
            where = where[order]
            at = np.concatenate((at, extra_end - extra_size))[order]
            until = np.concatenate((until, extra_end))[order]
        return buf, at, until, np.searchsorted(where, texts.offsets)

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: a flat array and where each begins."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        ids, at = self.pieces(gather(buf, starts, ends), ends - starts)
        sizes = np.array([len(s.encode()) for s in self.special], np.int64)
        for k in np.flatnonzero((buf[starts] == 60) & np.isin(ends - starts, sizes)):
            token = self.special.get(buf[starts[k]:ends[k]].tobytes().decode("utf-8", "replace"))
            if token is not None:  # its pieces become one id
                shift = at[k + 1] - at[k] - 1
                ids = np.concatenate((ids[:at[k]], np.array([token], np.uint32), ids[at[k + 1]:]))
                at[k + 1:] -= shift
        return ids, at


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The table of a vocabulary file, loaded once in each Python worker."""
    return WordBpe(path)


ENCODED = "id {id}, n_tokens bigint, ids binary, decoded string"


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    tokenizer: a file of the tokenizers library, BPE with a word-end suffix, at the same place on every executor.
    Returns one row for each row: the id column, n_tokens, ids (binary, little-endian unsigned 32-bit integers),
    decoded (the tokens with a space between, as a file without decoder has it). Null and empty texts have no ids;
    strings of special tokens in a text are those tokens. Repeated rows are repeated; other columns are left out.
    A task holds one block of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for texts in text_blocks(batches):
            buf, starts, ends, from_ = bpe.pre_tokens(texts)
            first, number, _ = distinct_spans(buf, starts, ends)
            ids, at = bpe.encode_spans(buf, starts[first], ends[first])
            sizes = np.diff(at)
            data, cut, text = ids.tobytes(), (4 * at).tolist(), [bpe.text_of[i] for i in ids.tolist()]
            coded = np.empty(len(first), object)
            coded[:] = [data[a:b] for a, b in itertools.pairwise(cut)]
            decoded = np.empty(len(first), object)
            decoded[:] = [" ".join(text[a:b]) for a, b in itertools.pairwise(at.tolist())]
            out_n, out_ids, out_text = [], [], []
            for a, b in itertools.pairwise(from_.tolist()):
                own = number[a:b]
                out_n.append(int(sizes[own].sum()))
                out_ids.append(b"".join(coded[own].tolist()))
                out_text.append(" ".join(decoded[own].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts.ids, id_type), pa.array(out_n, pa.int64()), pa.array(out_ids, pa.binary()),
                 pa.array(out_text, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType
    id_type = arrow_type(kind)
    out = source.mapInArrow(run, ENCODED.format(id=kind.simpleString()))
    return out.withColumnRenamed("id", id_col)
