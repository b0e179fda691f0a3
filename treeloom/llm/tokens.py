"""Token ids of whole texts by a public tokenizer, one Arrow batch at a time.

The vocabulary drops white space and never merges across it, so the ids of a text are the
ids of its blank-separated chunks in order. Chunks repeat, so each worker keeps the ids of
the chunks it has met (a bounded dictionary) and runs the tokenizer on new ones only.
Chunks are split at ASCII white space alone; the tokenizer itself sees every other character.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends every document.
END_ID = 1
#: Chunks kept by a worker, and the longest that is kept (bytes).
CACHE_CHUNKS = 300_000
CACHE_LONGEST = 48

#: Letters below this code point are single, composed and lower-cased one by one.
PLAIN_BELOW = "\u0250"


def _byte_letters() -> dict[int, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + n for n, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether every id fits in 16 bits.
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.folds_case = self.tokenizer.encode("Aa", add_special_tokens=False).ids == self.tokenizer.encode("aa", add_special_tokens=False).ids
        self.model, self.marks = self.tokenizer.model, {}
        probes = ["the", "été", "straße", "ñandú", "zzqxv", "łódź"]
        self.direct = self.folds_case and [self._word(w) for w in probes] == self._general(probes)
        # Two generations: chunks met again move to the young one, the old one is dropped when that is full.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.end = np.array([END_ID], "<u4").tobytes()

    def _general(self, chunks: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _word(self, letters: str) -> bytes:
        """The ids of a run of letters, straight from the merges."""
        if not (letters.isascii() and letters.islower()):
            letters = letters.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Plain words skip the tokenizer's own splitting; a closing full stop or comma is a piece."""
        out, others = [b""] * len(chunks), []
        young, old, marks = self.young, self.old, self.marks
        for k, c in enumerate(chunks):
            raw = c.rstrip(b".,")
            body = raw.decode("utf-8", "replace")
            if self.direct and body.isalpha() and (body.isascii() or (max(body) < PLAIN_BELOW and "\u0130" not in body)):
                if len(raw) == len(c):
                    out[k] = self._word(body)
                    continue
                mark = c[len(raw) :]
                if mark not in marks:
                    marks[mark] = self._general([mark.decode()])[0]
                out[k] = (young.get(raw) or old.get(raw) or self._word(body)) + marks[mark]
            else:
                others.append(k)
        for k, ids in zip(others, self._general([chunks[k].decode("utf-8", "replace") for k in others]), strict=True):
            out[k] = ids
        if len(self.marks) > 1000:
            self.marks = {}
        return out

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, encoding those not met lately."""
        young, old = self.young, self.old
        out, new = list(map(young.get, chunks)), []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = old.get(chunks[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = young[chunks[k]] = ids
        for at in range(0, len(new), 4096):
            part = [chunks[k] for k in new[at : at + 4096]]
            found = self._encode(part)
            young.update(zip(part, found, strict=True))
            for k, ids in zip(new[at : at + 4096], found, strict=True):
                out[k] = ids
        if len(young) > CACHE_CHUNKS:
            self.old = {c: v for c, v in young.items() if len(c) <= CACHE_LONGEST}
            self.young = {}
        return out

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text (null: empty), ended by END_ID."""
        texts = pc.fill_null(texts, "")
        # Where the tokenizer ignores case, it does not in the names of special tokens.
        if self.folds_case and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        known = self._known(raw_bytes(coded.dictionary))
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        flat = pool[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[a:b].tobytes() + self.end


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
