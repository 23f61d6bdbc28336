"""Token ids of whole texts by the tokenizers library, remembering chunks.

A text is cut where its tokens can't depend on what stands on the other side: before a run of spaces and line
breaks (byte-level vocabularies) or at white space that the vocabulary drops (word vocabularies). The library encodes
each chunk once; its ids are remembered as bytes in two generations of bounded size. A text with other white space or
special strings, where cuts could matter, is encoded whole; so is every text of a vocabulary whose file asks for
another normaliser or pre-tokeniser than these two kinds. Of a chunk of plain Latin letters and punctuation the
library's model is asked directly, as its normaliser and pre-tokeniser do nothing else there than lower the case,
part letters from punctuation and spell bytes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

from tracery.llm.grid import kept

#: Chunks in a generation, and the longest that is remembered.
REMEMBERED = 300_000
#: What stays between tasks: those met first, which are mostly the frequent ones.
CORE = 100_000
_LONGEST = 64
_CHUNK = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
#: White space besides spaces and line breaks, in UTF-8, and what every special string starts with.
_OTHER_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHOLE = [bytes([b]) for b in (9, *range(11, 14), *range(28, 32))] + [chr(c).encode() for c in _OTHER_SPACE] + [b"<|"]
#: A byte that no text in UTF-8 has.
_AS_IS = b"\xff"
#: Letters and then any marks of ASCII but an apostrophe, which may begin a contraction, and <, which begins special strings.
_PLAIN = re.compile(r"""([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)""")
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


#: The normalisers and pre-tokenisers of the two kinds of vocabularies whose texts may be cut.
_BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_LEVEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def kind_of(spec: dict) -> str | None:
    """"bytes" or "words" for a vocabulary's file whose texts may be cut as described above, else nothing."""
    model, rules = spec["model"], (spec.get("normalizer"), spec.get("pre_tokenizer"))
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    marked = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or ())
    if not plain or not marked:
        return None
    if rules == _BYTE_LEVEL and not model.get("end_of_word_suffix"):
        return "bytes"
    return "words" if rules == _WORD_LEVEL and model.get("end_of_word_suffix") else None


class _Known(dict):
    """The ids of chunks; those missing come from the older generation or from the library."""

    def __init__(self, look_up, old: dict[bytes, bytes], first=()):
        super().__init__(first)
        self.look_up, self.old = look_up, old

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.look_up(chunk)
        if len(chunk) <= _LONGEST:
            self[chunk] = ids
        return ids


class Encoder:
    """``encode`` gives the ids of texts, each as little-endian integers of ``dtype`` in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            self.kind = kind_of(json.load(f))
        self.drops_space = self.kind == "words"
        self.known = _Known(self._look_up, {})
        self.marks: dict[str, bytes] = {}

    def chunks(self, text: bytes) -> list[bytes]:
        """The names of a text's chunks: the chunk itself where white space is dropped or a line break leads;
        what follows where one space leads; otherwise the chunk behind a byte that no text has."""
        if self.kind is None:
            return [_AS_IS + text]
        if self.drops_space:
            return [_AS_IS + text] if b"<|" in text else text.split()
        for w in _WHOLE:
            if w in text:
                return [_AS_IS + text]
        if not text or text[0] in b" \n" or text[-1] in b" \n" or b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text:
            return [c[1:] if c[0] == 32 and len(c) > 1 and c[1] not in b" \n" else _AS_IS + c for c in _CHUNK.findall(text)]
        names = text.replace(b"\n", b" \n").split(b" ")
        names[0] = _AS_IS + names[0]
        return names

    def rest(self) -> None:
        """Shrinks what is remembered; called at the end of a task, as the worker may stand idle beside others."""
        most = self.known if len(self.known) >= min(CORE, len(self.known.old)) else self.known.old
        self.known = _Known(self._look_up, {}, islice(most.items(), CORE))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) >= REMEMBERED:
            self.known = _Known(self._look_up, dict(self.known))
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.chunks(t))) for t in texts]

    def _packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _look_up(self, name: bytes) -> bytes:
        if name[0] == 255:
            return self._packed(self.library.encode(name[1:].decode(), add_special_tokens=False).ids)
        text = name.decode()
        if plain := _PLAIN.fullmatch(text):
            lead, letters, rest = plain.groups()
            if self.drops_space:
                letters = letters.lower()
            elif not lead:
                letters = " " + letters
            if not letters.isascii():
                letters = "".join([_SPELLED[b] for b in letters.encode()])
            elif letters[0] == " ":
                letters = _SPELLED[32] + letters[1:]
            ids = [t.id for t in self.model.tokenize(letters)]
            if lead or rest:
                return (self._mark(lead) if lead and not self.drops_space else b"") + self._packed(ids) + (self._mark(rest) if rest else b"")
            return self._packed(ids)
        if not self.drops_space and text[0] != "\n":
            text = " " + text
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _mark(self, marks: str) -> bytes:
        """The ids of marks or a line break, which the pre-tokeniser leaves whole."""
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self._packed([t.id for t in self.model.tokenize("".join([_SPELLED[b] for b in marks.encode()]))])
        return self.marks[marks]


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return kept(("encoder", path), lambda: Encoder(path))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The texts in UTF-8; null counts as empty."""
    return [t or b"" for t in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()]
