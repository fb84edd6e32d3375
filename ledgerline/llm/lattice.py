"""Piece lattices: a double-array trie over a public piece vocabulary, and the sums and maxima over its segmentations.

No piece of such a vocabulary continues past the start of a new word, so the segmentations of a text are products of
those of its words; words are what the operators cache. A long word, such as a text in a script without spaces, is cut
wherever no piece reaches across, which leaves its segmentations the same; so only runs that pieces overlap without a gap
are stepped through at length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

MARK = "▁"  # stands for a space
UNK_PENALTY = 10.0
#: Characters from which a word is cut, those looked at together, and those of texts that are taken at once.
LONG_WORD, WINDOW, TEXT_CHARS = 64, 1 << 15, 1 << 21


class PieceLattice:
    """Normal pieces in a double-array trie over bytes: node ``s`` has child ``base[s] + byte + 1`` if ``check`` there is ``s``."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.scores = np.array([sp.get_score(i) for i in range(len(self.pieces))])
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
        normal = [i for i, x in enumerate(special) if not x]
        if any(MARK in self.pieces[i].lstrip(MARK) or " " in self.pieces[i] or "\n" in self.pieces[i] for i in normal):
            raise ValueError("a piece continues past the start of a word; words can't be taken one by one")
        self.normal = np.array(normal, np.int32)
        self.unk_score = float(self.scores[self.normal].min()) - UNK_PENALTY
        self.longest = max(len(self.pieces[i]) for i in normal)
        self._build([(self.pieces[i].encode(), i) for i in normal])

    def _build(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, i in keys:
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][b]
            value[at] = i
        size = len(children) * 2 + 1024
        base, check, values = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = bytearray(b"\x01" * size)
        free[0], first, stack = 0, 1, [(0, 0)]
        check[0] = 0
        while stack:
            node, slot = stack.pop()
            values[slot] = value[node]
            codes = [b + 1 for b in children[node]]
            if not codes:
                continue
            at = max(free.find(1, first), min(codes) + 1)
            first = free.find(1, first)
            while True:
                b = at - min(codes)
                if b > 0 and all(free[b + c] for c in codes):
                    break
                at = free.find(1, at + 1)
                if at + 257 >= len(free):
                    raise ValueError("the trie is larger than its arrays")
            base[slot] = b
            for byte, child in children[node].items():
                free[b + byte + 1] = 0
                check[b + byte + 1] = slot
                stack.append((child, b + byte + 1))
        self.base, self.check, self.value = base, check, values

    def edges(self, words: list[str]) -> dict:
        """All piece matches in the words, as arrays over one buffer in which word k begins at ``at[k]`` and ends at ``end[k]``.

        ``start``, ``to``, ``piece``: the matches, ordered by their distance from the word's start, then by word; ``bounds``
        splits them by that distance. ``chars``, ``chars_to``: every character; ``lone``: no piece is that character.
        """
        coded = [w.encode("utf-8", "replace") for w in words]
        buf = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        end = np.cumsum(size + 1) - 1
        at = end - size
        head = (buf & 0xC0) != 0x80
        head[end] = False
        chars = np.flatnonzero(head)
        word = np.searchsorted(end, chars)
        heads = np.append(chars, len(buf))
        chars_to = np.minimum(heads[1:], end[word]) if len(chars) else chars
        start, node, pos = chars, np.zeros(len(chars), np.int64), chars
        found: list[tuple] = []
        while len(start):
            nxt = self.base[node].astype(np.int64) + buf[pos] + 1
            ok = (self.check[nxt] == node) & (buf[pos] != 0)
            start, node, pos = start[ok], nxt[ok], pos[ok] + 1
            hit = self.value[node] >= 0
            if hit.any():
                found.append((start[hit], pos[hit], self.value[node[hit]]))
        s, e, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        base_of = at[np.searchsorted(end, s)] if len(s) else s
        order = np.argsort(s - base_of, kind="stable")
        s, e, p, off = s[order], e[order], p[order], (s - base_of)[order]
        single = np.zeros(len(buf) + 1, bool)
        reach = np.zeros(len(buf) + 1, np.int64)
        reach[chars] = chars_to
        single[s[reach[s] == e]] = True
        coff = chars - at[word] if len(chars) else chars
        corder = np.argsort(coff, kind="stable")
        chars, chars_to, coff = chars[corder], chars_to[corder], coff[corder]
        steps = np.unique(coff)
        return {"buf": buf, "at": at, "end": end, "start": s, "to": e, "piece": p.astype(np.int64), "bounds": np.searchsorted(off, np.append(steps, np.inf)), "chars": chars, "chars_to": chars_to, "lone": ~single[chars], "cbounds": np.searchsorted(coff, np.append(steps, np.inf))}

    def words(self, text: str) -> list[str]:
        """``words_of`` the text, long ones cut where no piece reaches across."""
        out = words_of(text)
        return [x for w in out for x in self.cut(w)] if any(len(w) > LONG_WORD for w in out) else out

    def cut(self, word: str) -> Iterator[str]:
        at, window = 0, WINDOW
        while len(word) - at > LONG_WORD:
            seen = word[at : at + window + self.longest]
            g = self.edges([seen])
            across = np.zeros(len(g["buf"]) + 1, np.int64)
            np.add.at(across, g["start"] + 1, 1)
            np.add.at(across, g["to"], -1)
            starts = np.sort(g["chars"])
            free = np.flatnonzero(np.cumsum(across)[starts] == 0)
            # A cut is sure where all pieces that begin before it lie in the window.
            free = free[(free > 0) & (free <= window)].tolist()
            if at + len(seen) < len(word) and not free:
                window *= 2
                continue
            cuts = [0, *free]
            yield from (seen[a:b] for a, b in zip(cuts, cuts[1:]))
            if at + len(seen) == len(word):
                yield seen[cuts[-1] :]
                return
            at, window = at + cuts[-1], WINDOW
        yield word[at:]

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations: (ids of all words one after the other, where each word's begin and the last ends, scores, byte pieces per word).

        A character without a piece is its bytes. Of equal segmentations, the one whose last piece starts first is taken.
        """
        g = self.edges(words)
        n = len(g["buf"]) + 1
        best, back, via = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        best[g["at"]] = 0.0
        for k in range(len(g["bounds"]) - 1):
            i, j = g["bounds"][k], g["bounds"][k + 1]
            self._better(best, back, via, g["start"][i:j], g["to"][i:j], g["piece"][i:j], self.scores[g["piece"][i:j]])
            i, j = g["cbounds"][k], g["cbounds"][k + 1]
            lone = g["lone"][i:j]
            if lone.any():
                self._better(best, back, via, g["chars"][i:j][lone], g["chars_to"][i:j][lone], -1, self.unk_score)
        chosen, spelt, at, pos = np.full(n, -1, np.int64), np.zeros(n, bool), g["at"], g["end"]
        while len(pos):  # one piece of every word, from the last one on
            more = pos > at
            at, pos = at[more], pos[more]
            before = back[pos]
            piece = via[pos]
            chosen[before] = piece
            for p, q in zip(before[piece < 0].tolist(), pos[piece < 0].tolist()):
                chosen[p:q] = self.byte_ids[g["buf"][p:q]]
                spelt[p:q] = True
            pos = before
        taken = chosen >= 0
        count = np.concatenate(([0], np.cumsum(taken)))
        byte_count = np.concatenate(([0], np.cumsum(spelt)))
        return chosen[taken].astype("<i4"), np.append(count[g["at"]], count[-1]), best[g["end"]], byte_count[g["end"]] - byte_count[g["at"]]

    @staticmethod
    def _better(best, back, via, start, to, piece, score) -> None:
        new = best[start] + score
        up = new > best[to]
        best[to[up]], back[to[up]], via[to[up]] = new[up], start[up], piece[up] if isinstance(piece, np.ndarray) else piece

    def byte_path(self, logp: np.ndarray, g: dict) -> np.ndarray:
        """Log probability of each character of ``g`` spelt in byte pieces: (languages, characters)."""
        run = np.zeros((logp.shape[0], len(g["buf"]) + 1))
        np.cumsum(logp[:, self.byte_ids[g["buf"]]], axis=1, out=run[:, 1:])
        return run[:, g["chars_to"]] - run[:, g["chars"]]

    def forward(self, words: list[str], logp: np.ndarray, g: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log sum over all segmentations of each word, for each row of ``logp`` (languages, pieces): (languages, words), and the alphas."""
        g = g or self.edges(words)
        alpha = np.full((logp.shape[0], len(g["buf"]) + 1), -np.inf)
        alpha[:, g["at"]] = 0.0
        spelt = self.byte_path(logp, g)
        with np.errstate(invalid="ignore"):
            for k in range(len(g["bounds"]) - 1):
                i, j = g["bounds"][k], g["bounds"][k + 1]
                alpha[:, g["to"][i:j]] = np.logaddexp(alpha[:, g["to"][i:j]], alpha[:, g["start"][i:j]] + logp[:, g["piece"][i:j]])
                i, j = g["cbounds"][k], g["cbounds"][k + 1]
                to = g["chars_to"][i:j]
                alpha[:, to] = np.logaddexp(alpha[:, to], alpha[:, g["chars"][i:j]] + spelt[:, i:j])
        return alpha[:, g["end"]], alpha

    def expected(self, words: list[str], weight: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts under ``logp`` (pieces,), the words weighted; by forward and backward sums."""
        g = self.edges(words)
        total, alpha = self.forward(words, logp[None], g)
        alpha, beta = alpha[0], np.full(len(g["buf"]) + 1, -np.inf)
        beta[g["end"]] = 0.0
        spelt = self.byte_path(logp[None], g)[0]
        for k in range(len(g["bounds"]) - 2, -1, -1):
            i, j = g["bounds"][k], g["bounds"][k + 1]
            np.logaddexp.at(beta, g["start"][i:j], logp[g["piece"][i:j]] + beta[g["to"][i:j]])
            i, j = g["cbounds"][k], g["cbounds"][k + 1]
            own = g["chars"][i:j]
            beta[own] = np.logaddexp(beta[own], spelt[i:j] + beta[g["chars_to"][i:j]])
        word = np.searchsorted(g["end"], g["start"])
        share = np.exp(alpha[g["start"]] + logp[g["piece"]] + beta[g["to"]] - total[0][word]) * weight[word]
        out = np.bincount(g["piece"], share, len(logp)).astype(float)
        word = np.searchsorted(g["end"], g["chars"])
        share = np.exp(alpha[g["chars"]] + spelt + beta[g["chars_to"]] - total[0][word]) * weight[word]
        for n in range(1, 5):  # characters of n bytes give a count to each of their bytes
            own = (g["chars_to"] - g["chars"]) == n
            for k in range(n):
                out = out + np.bincount(self.byte_ids[g["buf"][g["chars"][own] + k]], share[own], len(logp))
        return out


_runs = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def words_of(text: str) -> list[str]:
    """The text's words with their space marks, a line feed being a word of its own; joined, they are the marked text behind a first mark."""
    if MARK in text or "  " in text or text.endswith(" ") or " \n" in text:
        return _runs.findall(MARK + text.replace(" ", MARK))
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
            if line:
                out.extend(line.replace(" ", " " + MARK).split(" "))
        elif line:
            out.extend((MARK + line.replace(" ", " " + MARK)).split(" "))
        else:
            out.append(MARK)
    return [w for w in out if w]


def by_chars(texts: list[str | None], most: int = 200) -> Iterator[slice]:
    """Slices of at most ``most`` texts, and of about ``TEXT_CHARS`` characters unless one text is longer."""
    at = chars = 0
    for k, t in enumerate(texts):
        if k > at and (k - at >= most or chars + len(t or "") > TEXT_CHARS):
            yield slice(at, k)
            at, chars = k, 0
        chars += len(t or "")
    if at < len(texts):
        yield slice(at, len(texts))


def by_length(words: list[str]) -> list[list[str]]:
    """Words in batches of like length, so that a long one doesn't make short ones wait."""
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w).bit_length()].append(w)
    return [own[i : i + step] for bits, own in groups.items() for step in [max(1, min(20_000, (1 << 20) >> bits))] for i in range(0, len(own), step)]
