"""Token ids of whole texts, by the tokenizers library, in tasks.

Encoding the same word again and again is most of the work, so each Python worker keeps
the ids of pieces between spaces. A piece's ids don't depend on its neighbours: both
vocabularies split at each space, and a space belongs to the piece after it. Texts with
runs of white space that hold a space inside, where that isn't so, are encoded whole, and
so are texts that spell out a special token, which the library finds first.

Most new pieces are a word of plain letters, some with marks after it. Both vocabularies
split between the two and nowhere else, so the library's model gets such words already
split, many at a time; other new pieces take the library's whole path. Where a vocabulary
has a letter that no merge takes in, many words are one sequence for the model, with that
letter between them: merges don't cross it, so the ids are those of the words alone. The
store of pieces is bounded; beyond the bound new pieces are encoded again each time.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_ID = 2
STORE_BOUND = 300_000  # pieces kept by a worker
GROUP_CHARS = 1_000_000  # texts taken together
JOINED, AT_ONCE = 400, 10  # pieces encoded as one text, and such texts at a time
_INNER_RUN = re.compile(r"\s \s|\s $|^\s* ")
_APART = re.compile(r"[\s\x01]")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)%#&$*\"]*)")  # a word of plain letters, and marks
_LINES = re.compile(_PLAIN.pattern + r"\n" + _PLAIN.pattern)  # two such, one line break between them
_RARE_SPACE = re.compile(r"[\x1c-\x1f]")  # white space for Python, not for the vocabularies
_workers: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _holes(row: list) -> list[int]:
    """Where row holds None."""
    out: list[int] = []
    for _ in range(row.count(None)):
        out.append(row.index(None, out[-1] + 1 if out else 0))
    return out


def _blank(piece: str) -> bool:
    return not piece or piece[0].isspace()


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without the end id.

    lead: whether a piece is encoded with the space before it (byte-level vocabularies),
    or white space is dropped and letters are lower-cased (word-level vocabularies).
    """

    def __init__(self, path: str, lead: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = Tokenizer(self.model.model)  # takes words that are split and written as byte letters
        self.letters = byte_letters()
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.lead, self.store, self.tails, self.heads, self.bare = lead, {}, {"": b""}, {}, {}
        # a mark of one id that stands between pieces, so that many are encoded as one text
        self.between = "\n" if lead else " \x01 "
        mark = self.whole([self.between.strip(" ")])[0]
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None
        self.wall, self.line = self._unmerged(), mark if lead else b""

    def _unmerged(self) -> tuple[str, int] | None:
        """A letter that no merge takes in nor any word holds, and its id, if words side by side with it merge as they do alone."""
        form = json.loads(self.model.to_str())["model"]
        if form["type"] != "BPE" or form.get("end_of_word_suffix") or form.get("continuing_subword_prefix") or form.get("dropout") or form.get("ignore_merges"):
            return None
        merged = {x for m in form["merges"] for part in (m if isinstance(m, list) else m.split(" ")) for x in part}
        shown = (self.letters[b] for b in range(0x20))  # of control characters: not in a word of plain letters
        return next(((x, form["vocab"][x]) for x in shown if x in form["vocab"] and x not in merged), None)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, encoded: list, counts: list[int], again, mark: int | None = None) -> list[bytes]:
        """The ids of each piece, of texts that hold pieces with the mark between them."""
        out: list[bytes] = []
        mark = self.mark if mark is None else mark
        for k, (e, n) in enumerate(zip(encoded, counts, strict=True)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = (np.flatnonzero(ids == mark) * 4).tolist()
            if len(cuts) != n - 1:
                out += again(k)
            else:
                data = ids.tobytes()
                out += [data[a:z] for a, z in zip([0, *[c + 4 for c in cuts]], [*cuts, len(data)], strict=True)]
        return out

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space or the mark, encoded side by side."""
        out: list[bytes] = []
        space = " " if self.lead else ""
        for k in range(0, len(pieces), JOINED * AT_ONCE):
            parts = [[space + p for p in pieces[i : i + JOINED]] for i in range(k, min(k + JOINED * AT_ONCE, len(pieces)), JOINED)]
            encoded = self.model.encode_batch_fast([self.between.join(part) for part in parts], add_special_tokens=False)
            out += self._cut(encoded, [len(part) for part in parts], lambda n: self.whole(parts[n]))  # noqa: B023
        return out

    def _spelt(self, word: str, spaced: bool = True) -> str:
        """A word of plain letters as the model has it, with the space before it or without."""
        word = word if self.lead else word.lower()
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self.letters[0x20] + written if self.lead and spaced else written

    def _words(self, words: list[str], spaced: bool = True) -> list[bytes]:
        """Ids of words of plain letters, encoded side by side without another split."""
        out: list[bytes] = []
        mark, id_ = self.wall or (self.letters[0x0A] if self.lead else self.letters[0x01], self.mark)
        for k in range(0, len(words), JOINED * AT_ONCE):
            parts = [[self._spelt(w, spaced) for w in words[i : i + JOINED]] for i in range(k, min(k + JOINED * AT_ONCE, len(words)), JOINED)]
            rows = [[mark.join(part)] if self.wall else [x for w in part for x in (w, mark)][:-1] for part in parts]
            encoded = self.words.encode_batch_fast(rows, is_pretokenized=True, add_special_tokens=False)
            out += self._cut(encoded, [len(part) for part in parts], lambda n: [np.array(self.words.encode([w], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes() for w in parts[n]], id_)  # noqa: B023
        return out

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        plain, words, marks = [], [], []
        lines, others, odd = [], [], []
        for p in pieces:
            m = _PLAIN.fullmatch(p) if self.mark is not None else None
            if m:
                plain.append(p)
                words.append(m[1])
                marks.append(m[2])
            elif self.lead and self.mark is not None and (m := _LINES.fullmatch(p)):
                lines.append((p, m))
            else:
                (odd if self.mark is None or not p or _APART.search(p) else others).append(p)
        found.update(zip(odd, self.whole([" " + p for p in odd] if self.lead else odd), strict=True))
        found.update(zip(others, self._many(others), strict=True))
        tails = list(set(marks).union(x for _, m in lines for x in (m[2], m[4])).difference(self.tails))
        self.tails.update(zip(tails, self.whole(tails), strict=True))
        known = {w: self.store.get(w) for w in (*words, *(m[1] for _, m in lines))}
        unknown = [w for w, x in known.items() if x is None]
        known.update(zip(unknown, self._words(unknown), strict=True))
        found.update(zip(plain, [known[w] + self.tails[t] for w, t in zip(words, marks, strict=True)], strict=True))
        if lines:
            if len(self.bare) > 50_000:
                self.bare = {}
            bare = list({m[3] for _, m in lines}.difference(self.bare))
            self.bare.update(zip(bare, self._words(bare, False), strict=True))
            found.update((p, known[m[1]] + self.tails[m[2]] + self.line + self.bare[m[3]] + self.tails[m[4]]) for p, m in lines)
        if len(self.store) + len(found) + len(unknown) <= STORE_BOUND:
            # pieces that begin with white space, and empty ones, aren't kept: see _group
            self.store.update((p, x) for p, x in found.items() if p and not p[0].isspace())
            self.store.update((w, known[w]) for w in unknown)
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        return found

    def _firsts(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without a space before them."""
        if len(self.heads) > 20_000:
            self.heads = {}
        new = list(set(pieces).difference(self.heads))
        self.heads.update(zip(new, self.whole(new), strict=True))
        return [self.heads[p] for p in pieces]

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        if special:
            for i, ids in zip(special, self.whole([texts[i] for i in special]), strict=True):
                out[i] = ids
        rest = [i for i in range(len(texts)) if out[i] is None]
        skip = int(self.lead)
        pieces = [texts[i].split(" ") if self.lead or _RARE_SPACE.search(texts[i]) else texts[i].split() for i in rest]
        firsts = self._firsts([p[0] for p in pieces]) if self.lead else [b""] * len(rest)
        get = self.store.get
        ids = [list(map(get, p[skip:])) for p in pieces]
        holes = [_holes(row) for row in ids]
        if self.lead:
            # a run with a space inside leaves a piece that is empty or begins with white space: a hole, as none is kept
            odd = [n for n, (p, hole) in enumerate(zip(pieces, holes, strict=True)) if (_blank(p[0]) or any(_blank(p[k + 1]) for k in hole)) and _INNER_RUN.search(texts[rest[n]])]
            for n, found in zip(odd, self.whole([texts[rest[n]] for n in odd]), strict=True):
                ids[n], firsts[n], holes[n] = [found], b"", ()
        if new := {p[k + skip] for p, hole in zip(pieces, holes, strict=True) for k in hole}:
            found = self._new(list(new))
            for p, row, hole in zip(pieces, ids, holes, strict=True):
                for k in hole:
                    row[k] = found[p[k + skip]]
        for n, i in enumerate(rest):
            out[i] = firsts[n] + b"".join(ids[n])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in order."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out


def encoder(path: str, lead: bool) -> PieceEncoder:
    """The encoder of this Python worker, made once; it holds one vocabulary at a time."""
    if (path, lead) not in _workers:
        _workers.clear()
        _workers[path, lead] = PieceEncoder(path, lead)
    return _workers[path, lead]
