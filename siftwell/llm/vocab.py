"""Encoders over public vocabulary files, as used inside tasks.

A file is read once on the driver and shipped as bytes (fixed size, 1 to 2 MB), so executors need no
path. Every encoder gives exactly the ids of its library: texts made only of common characters take a
quicker way that was checked against the library, all others go through the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on whose classes (letter, number, space) all Unicode versions and regex engines agree.
COMMON = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-įĲ-ɏ]*")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def byte_names() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: a byte that prints keeps its
    character, the others take the characters from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Store(dict):
    """Values of words, made when first asked for.

    The words of a text are independent, so a store changes no result; ``trim`` empties it when it holds
    ``keep`` words, which bounds its memory.
    """

    def __init__(self, make, keep: int = 300_000):
        self.make, self.keep = make, keep

    def __missing__(self, word):
        self[word] = got = self.make(word)
        return got

    def trim(self) -> None:
        if len(self) > self.keep:
            self.clear()


class Library:
    """A ``tokenizers`` file; ``ids`` as ``encode(text, add_special_tokens=False).ids``.

    Common texts without special strings take ``common``; all others go through the library whole.
    """

    #: What a token of the vocabulary ends with at the end of a word, and the byte that stands for it.
    END, MARK = "", b""

    def __init__(self, file: bytes, pattern: str = "."):
        import tiktoken

        self.file = file
        data, names = json.loads(file), byte_names()
        self.special = tuple(t["content"] for t in data["added_tokens"])
        ranks = {}
        for word, i in data["model"]["vocab"].items():
            if word not in self.special:
                ends = self.END and word.endswith(self.END)
                body = word[: -len(self.END)] if ends else word
                ranks[bytes(names[c] for c in body) + (self.MARK if ends else b"")] = i
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The library itself, read when the first text asks for it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(self.file.decode())
        whole.no_truncation()
        whole.no_padding()
        return whole

    def common(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def ids(self, text: str) -> np.ndarray:
        if COMMON.fullmatch(text) and not any(s in text for s in self.special):
            return self.common(text)
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


class ByteLevel(Library):
    """Byte-level BPE; ``pattern`` is the file's way to cut texts."""

    def common(self, text: str) -> np.ndarray:
        return self.quick.encode_to_numpy(text, disallowed_special=())


class WordLevel(Library):
    """BPE with word ends over lower-cased words. White space is dropped, so it bounds every piece and the
    ids of a chunk between white space never depend on its neighbours.

    A word's last character carries the end mark. Byte 127, which no common text holds, stands for the mark:
    the symbols it forms with the last byte have the lowest ids after the bytes, so they are formed first.
    Texts are taken many at a time: Arrow cuts them into chunks, and each distinct chunk is encoded once.
    """

    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|[0-9]|[^\s\p{L}0-9]+"
    END, MARK = "</w>", b"\x7f"
    #: Bytes of texts, and distinct chunks, that are worked on at a time; both only bound memory.
    SLICE, BLOCK = 16 << 20, 100_000

    def __init__(self, file: bytes):
        super().__init__(file, r"\n|[^\x7f\s]+\x7f")
        self.newline = self.quick.encode_single_token(b"\n")  # no word holds one: it ends a chunk's ids

    def lists(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each chunk."""
        ids, ends, before = [np.empty(0, "<u4")], [np.zeros(1, "i4")], 0
        for at in range(0, len(chunks), self.BLOCK):
            marked = pc.replace_substring_regex(chunks.slice(at, self.BLOCK), self.WORD, "\\0\x7f")
            lines = pc.binary_join(pa.ListArray.from_arrays([0, len(marked)], marked), "\n")[0].as_py() + "\n"
            found = self.quick.encode_to_numpy(lines, disallowed_special=())
            last = found == self.newline
            ends.append((before + np.cumsum(~last)[last]).astype("i4"))
            ids.append(found[~last])
            before += len(ids[-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends)), pa.array(np.concatenate(ids)))

    def commons(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        chunks = words.values.dictionary_encode()
        found = self.lists(chunks.dictionary).take(chunks.indices)
        ids, ends = found.values.to_numpy(), found.offsets.to_numpy()[words.offsets.to_numpy()]
        return (ids[a:b] for a, b in zip(ends, ends[1:]))

    def common(self, text: str) -> np.ndarray:
        return next(self.commons(pa.array([text])))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``ids`` of each text; null is empty."""
        texts = texts.fill_null("")
        common = pc.match_substring_regex(texts, rf"\A{COMMON.pattern}\z")
        for special in self.special:
            common = pc.and_not(common, pc.match_substring(texts, special))
        sizes = pc.binary_length(texts).to_numpy().astype("i8")
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // self.SLICE)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            part, plain = texts.slice(a, b - a), common.slice(a, b - a)
            quick = self.commons(part.filter(plain))
            for text, is_plain in zip(part, plain.to_pylist()):
                yield next(quick) if is_plain else self.ids(text.as_py())
