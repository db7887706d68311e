"""Token ids by the tokenizers library, with a bounded memo of words.

The byte-level model never merges across pre-tokens, and a single space or line feed before
a visible character always opens one. So the ids of a text are the concatenation of the ids
of its chunks: what stands before the first space or line feed, then each of them with what
follows it. The library encodes each distinct chunk once per worker, all new ones of a
batch in one call; texts in which the cut could be in doubt (odd white space, scripts beyond
Cyrillic, one of the vocabulary's added tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

END_ID = 2
END = np.array([END_ID], "<u4").tobytes()
MEMO_ENTRIES = 600_000  # of a generation of the memo, some 200 bytes each; two are kept
CHARS_AT_ONCE = 4_000_000

# What is left of a text without its visible ASCII, spaces, tabs and line feeds must be two-byte characters.
_USUAL = bytes([9, 10, *range(0x20, 0x7F)])
_RARE = re.compile(rb"[\x00-\x7f\xd5-\xff]|\xc2[\x80-\xa0]")
WORDS_AT_ONCE = 2000
MARKS = ".,;:!?%$#*&|<>"  # a run of them after letters is a pre-token of its own


def _in_doubt(text: str) -> bool:
    """Whether a space may not open a pre-token, or the libraries' character classes may differ."""
    if text[-1] == " " or "  " in text or " \n" in text or " \t" in text or "\n\n" in text:
        return True
    rest = text.encode("utf-8", "surrogatepass").translate(None, _USUAL)
    return _RARE.search(rest) is not None


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts -> ids as little-endian 32-bit bytes, as the library's plain call gives them: an added token in a text is that token."""

    def __init__(self, vocabulary: str, memo_entries: int):
        from tokenizers import Tokenizer, pre_tokenizers

        # Every core has a task of its own, so threads beside it would only wait for work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo_entries = memo_entries
        self.model = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # The same model for chunks of a word only, given in the model's own alphabet of visible bytes.
        self.words = Tokenizer(self.model.model)
        self.cut = {" ": pre_tokenizers.Split("Ġ", "merged_with_next"), "\n": pre_tokenizers.Split("Ċ", "isolated")}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        ids = self.model.get_vocab()
        self.opens = {mark: np.zeros(max(ids.values()) + 1, bool) for mark in self.cut}  # ids of tokens that open a chunk
        self.opens[" "][[i for w, i in ids.items() if w.startswith("Ġ")]] = True
        self.opens["\n"][ids["Ċ"]] = True
        self.marks: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # ids of a chunk; the space before it is left out of the key, a line feed is not
        self.before: dict[str, bytes] = {}  # the generation before: what is met again moves on from it

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _add(self, chunks: list[str], joined: str, model, opens: np.ndarray) -> None:
        """Joined, chunks are cut at the same places again, before each space or line feed."""
        ids = np.array(model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        raw, at = ids.tobytes(), (4 * np.flatnonzero(opens[ids])).tolist()
        if len(at) != len(chunks):
            raise ValueError("the vocabulary splits a word off its leading space")
        self.chunks.update(zip(chunks, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))

    def _unknown(self, chunks: set[str]) -> set[str]:
        """Those that the generation before does not have either; the others move on."""
        found = list(chunks & self.before.keys())
        self.chunks.update(zip(found, map(self.before.__getitem__, found)))
        return chunks.difference(found)

    def _mark(self, run: str) -> bytes:
        if run not in self.marks:
            self.marks[run] = self.whole(run)
        return self.marks[run]

    def _learn(self, missing: set[str]) -> None:
        plain = set(filter(str.isalpha, missing))
        words: dict[str, list[str]] = {" ": list(plain), "\n": []}
        marked, other = [], []
        for c in missing - plain:
            core = c.rstrip(MARKS)
            if core.isalpha():
                marked.append((c, core))
            elif core[:1] == "\n" and core[1:].isalpha():
                if len(core) < len(c):
                    marked.append((c, core))
                else:
                    words["\n"].append(c)
            elif c[:1] == "\n":
                self.chunks[c] = self.whole(c)
            else:
                other.append(c)
        cores = self._unknown({core for _, core in marked}.difference(self.chunks, missing))
        words["\n"] += [c for c in cores if c[0] == "\n"]
        words[" "] += [c for c in cores if c[0] != "\n"]
        for mark, todo in words.items():
            self.words.pre_tokenizer = self.cut[mark]
            for k in range(0, len(todo), WORDS_AT_ONCE):
                part = todo[k : k + WORDS_AT_ONCE]
                joined = "".join(part) if mark == "\n" else " " + " ".join(part)
                self._add(part, joined.encode().decode("latin-1").translate(self.alphabet), self.words, self.opens[mark])
        for k in range(0, len(other), WORDS_AT_ONCE):
            part = other[k : k + WORDS_AT_ONCE]
            self._add(part, " " + " ".join(part), self.model, self.opens[" "])
        for c, core in marked:
            self.chunks[c] = self.chunks[core] + self._mark(c[len(core) :])

    def some(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        if len(self.chunks) > self.memo_entries:
            self.before, self.chunks = self.chunks, {}
        plain = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _in_doubt(text) or any(t in text for t in self.added):
                out[i] = self.whole(text)
            else:
                plain.append(i)
        if not plain:
            return out
        split = pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        first, words = split.offsets.to_numpy()[:-1], split.values
        tail = np.ones(len(words), bool)
        tail[first] = False
        heads = self.model.encode_batch_fast(words.take(pa.array(first)).to_pylist(), add_special_tokens=False)
        # A batch's words are numbered, so that each distinct one is looked up once.
        numbered = words.filter(pa.array(tail)).dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        if missing := self._unknown(set(distinct).difference(self.chunks)):
            self._learn(missing)
        codes = list(map(self.chunks.__getitem__, distinct))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        number = numbered.indices.to_numpy()
        length, ends = sizes[number], np.concatenate(([0], np.cumsum(sizes[number])))
        place = np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], length) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(codes), "<u4")[place].tobytes()
        cut = (4 * ends[np.append(first, len(words)) - np.arange(len(plain) + 1)]).tolist()
        for i, head, a, b in zip(plain, heads, cut, cut[1:]):
            out[i] = np.array(head.ids, "<u4").tobytes() + ids[a:b]
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text or "")
            if chars >= CHARS_AT_ONCE:
                out += self.some(some)
                some, chars = [], 0
        return out + self.some(some)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, memo_entries: int = MEMO_ENTRIES) -> Encoder:
    """One per worker process. It stays for the tasks to come, until :func:`forget`."""
    if (vocabulary, memo_entries) not in _ENCODERS:
        _ENCODERS[vocabulary, memo_entries] = Encoder(vocabulary, memo_entries)
    return _ENCODERS[vocabulary, memo_entries]


def forget() -> None:
    """Drop the worker's encoders, where other stages are to use its memory next."""
    _ENCODERS.clear()
    common.give_back()


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
