"""Whole texts to token ids, as the tokenizers library gives them, with a memo for pieces that recur.

A text is cut only where the tokenizer itself always cuts, so that the ids of the pieces, put
together, are the ids of the text: with a tokenizer that drops white space, at every space and line
end; with a byte-level one, before a space or line end that stands between other characters. Texts
with any other pattern of white space go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces kept by one encoder; the memo starts anew when it is full.
MEMO = 500_000

#: White space other than a line end at the start of a piece: such a piece isn't cut safely.
_ODD = re.compile(r"[\s\x1c-\x1f]")

#: A word of Latin letters and the punctuation after it: every style of cutting parts the two.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-^`{-~]*)")

_encoders: dict[str, Encoder] = {}


def _style(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "leads"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers") or [{}]
    if kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
        return "drops"
    return "whole"


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit numbers, without special tokens."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.style = _style(json.load(f))
        self.size = self.tokenizer.get_vocab_size()
        self.limit, self.memo, self.words, self.marks = memo, {}, {}, {}
        at_end = self.style == "drops"  # where the first, or the last, id of a word shows in the id itself
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if at_end else t.startswith("\u0120"))]] = True

    def _library(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _split(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, from one text that has them all."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(" " + w for w in words)], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return self._library(words if self.style == "drops" else [" " + w for w in words])
        cuts = np.concatenate(([0], edges + 1)) if self.style == "drops" else np.concatenate((edges, [len(ids)]))
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _latin(self, new: list[str]) -> list[str]:
        """Learn the pieces that are a Latin word and punctuation, part by part; return the others."""
        parts, rest = [], []
        for piece in new:
            found = _WORD.fullmatch(piece)
            if found:
                word, mark = found.groups()
                parts.append((piece, word.lower() if self.style == "drops" else word, mark))
            else:
                rest.append(piece)
        words = list({w for _, w, _ in parts if w not in self.words})
        if words:
            self.words.update(zip(words, self._split(words), strict=True))
        marks = list({m for *_, m in parts if m and m not in self.marks})
        self.marks.update(zip(marks, self._library(marks), strict=True))
        self.memo.update((piece, self.words[word] + self.marks[mark] if mark else self.words[word]) for piece, word, mark in parts)
        return rest

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that follow a cut at a space, or begin with a line end; None marks one that can't be cut there."""
        new = self._latin(list({p for p in pieces if p not in self.memo}))
        memo = self.memo
        if self.style == "drops":
            memo.update(zip(new, self._library(new), strict=True))
            return
        fine = [p for p in new if len(p) > (p[:1] == "\n") and not _ODD.search(p, 1 if p[:1] == "\n" else 0)]
        memo.update(dict.fromkeys(new))
        memo.update(zip(fine, self._library([p if p[0] == "\n" else " " + p for p in fine]), strict=True))

    def encode(self, text: str) -> bytes:
        if self.style == "whole" or not text:
            return self._library([text])[0]
        if len(self.memo) > self.limit:
            self.memo.clear()
        if len(self.words) > self.limit:
            self.words.clear()
            self.marks.clear()
        if self.style == "drops":
            pieces, first = text.replace("\n", " ").split(" "), b""
        else:
            head, _, rest = text.replace("\n", " \n").partition(" ")
            if not head or _ODD.search(head):
                return self._library([text])[0]
            if len(head) == len(text):
                return self._library([head])[0]
            first, pieces = self._library([head])[0], rest.split(" ")
        try:
            return first + b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
        except TypeError:
            return self._library([text])[0]
        try:
            return first + b"".join(map(self.memo.__getitem__, pieces))
        except TypeError:
            return self._library([text])[0]


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
