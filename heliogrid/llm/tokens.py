"""Token ids of whole texts through the tokenizers library, with a bounded memo of units.

A text is cut at white space that provably ends a token, and every distinct unit is
encoded by the library once; a text in which such a cut could change the result goes
through the library whole, as does one that holds one of its added tokens. The ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import cache
from itertools import islice

import numpy as np

#: Code points that libraries class differently as white space, and all white space but the blank and the line end.
_ODD = [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD_SET = re.compile("[" + "".join(map(chr, _ODD)) + "]")
_ODD_ASCII = [chr(c) for c in _ODD if c < 128]
#: Entries kept by one Python worker during a task; about 200 bytes each.
MEMO = 800_000
#: Entries that stay for its next task where memory counts more than time.
RESTING = 150_000


class UnitEncoder:
    """``encode_all(texts)`` gives little-endian unsigned 32-bit ids of each text, end id added.

    ``blank_joins``: the vocabulary joins a blank to the word after it (byte-level BPE);
    otherwise white space only separates units and leaves no id.
    """

    def __init__(self, path: str, end_id: int, blank_joins: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the library looks for these before anything else, and some take white space along
        added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.added = added
        self.blank_joins = blank_joins
        self.end = np.array([end_id], "<u4").tobytes()
        self.mark = "\n" if blank_joins else " ~ "
        ids = self.library.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else -1
        self.memo: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 2048):
            part = self.library.encode_batch_fast(texts[k : k + 2048], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in part]
        return out

    def _many(self, units: list[str]) -> dict[str, bytes]:
        """Ids of distinct units: thousands a call, with a mark between them that is a token of its own."""
        mark = self.mark.strip(" ")
        plain = [x for x in units if mark not in x and not x.isspace() and x]
        out: dict[str, bytes] = {}
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            if len(cuts) != len(part) - 1:  # the mark isn't a token of its own here
                out.update(zip(part, self._library(part), strict=True))
                continue
            raw = ids.tobytes()
            out.update(zip(part, [raw[4 * s : 4 * e] for s, e in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)])], strict=True))
        rest = [x for x in units if x not in out]
        out.update(zip(rest, self._library(rest), strict=True))
        return out

    def _units(self, text: str) -> list[str] | None:
        """Words of ``text`` in order; None: it has to be encoded whole."""
        # one search for a fixed string after the other takes a fraction of one for any of them
        odd = any(map(text.__contains__, _ODD_ASCII)) if text.isascii() else _ODD_SET.search(text)
        if odd or any(map(text.__contains__, self.added)):
            return None
        if not self.blank_joins:
            return text.split()
        if "  " in text:  # a run of blanks is one token up to its last blank
            return None
        return text.split(" ")

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        # with blank_joins a memo key stands for the blank and the word; the first word of a text has no blank
        memo, joins = self.memo, self.blank_joins
        cut = [self._units(t) for t in texts]
        heads = {u[0]: b"" for u in cut if u} if joins else {}
        if joins:
            heads = self._many([h for h in heads if h]) | {"": b""}
        whole = [t for t, u in zip(texts, cut, strict=True) if u is None]
        new = list(set().union(*(u for u in cut if u is not None)) - memo.keys())
        if joins:
            got = self._many([" " + x for x in new])
            memo.update((x, got[" " + x]) for x in new)
        else:
            memo.update(self._many(new))
        rest = iter(self._library(whole))
        join, get = b"".join, memo.__getitem__
        out = []
        for u in cut:
            if u is None:
                out.append(next(rest) + self.end)
            elif joins:
                out.append(heads[u[0]] + join(map(get, u[1:])) + self.end)
            else:
                out.append(join(map(get, u)) + self.end)
        if len(memo) > MEMO:  # the units met first are the frequent ones: they stay
            for x in new:
                del memo[x]
        return out


    def rest(self) -> None:
        """Keep the units met first, the frequent ones, so that the worker doesn't hold the others through tasks of other kinds."""
        if len(self.memo) > RESTING:
            self.memo = dict(islice(self.memo.items(), RESTING))


@cache
def encoder(path: str, end_id: int, blank_joins: bool) -> UnitEncoder:
    """One encoder, with its memo, per Python worker."""
    return UnitEncoder(path, end_id, blank_joins)


def batches(texts: list[str | None], size: int = 4 << 20) -> Iterable[tuple[int, list[str]]]:
    """(first place, texts) in runs of about ``size`` characters; null counts as empty."""
    first, run, n = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t or "")
        n += len(t or "")
        if n >= size:
            yield first, run
            first, run, n = k + 1, [], 0
    if run:
        yield first, run
