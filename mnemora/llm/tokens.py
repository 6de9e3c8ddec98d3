"""Token ids and counts of a public tokenizer file, exactly as its library gives them.

No merge, normaliser or split of this tokenizer looks across white space, so a text's ids are the ids of its runs between
ASCII white space, in order. Tasks keep a bounded memo of runs (runtable.py); a run that is new is split into
pre-tokens, of which those that are proven to be whole tokens are looked up and the others go to the library's model. Texts that hold a special string go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

from mnemora.llm.textkernels import NOT_SPACE, chunks_of, joined, tokens
from mnemora.llm.tokentable import TokenTable

MERGED = 200_000
"""Most pre-tokens of a worker's memo of merges; it starts anew beyond them."""

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a .json file, kept by each Python worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


def _specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


SPACE, LETTER, MARK, DIGIT, OTHER = range(5)
_kind = np.full(256, OTHER, dtype=np.uint8)
_kind[33:127] = MARK
_kind[48:58] = DIGIT
_kind[65:91] = _kind[97:123] = LETTER
_kind[NOT_SPACE == 0] = SPACE
_kind[ord("'")] = OTHER  # may begin a pre-token that takes letters with it
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def pre_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends): plain runs lower-cased and cut into letters, single digits and other marks; other runs whole."""
    kind = _kind[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    latin = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]  # the letters from U+00C0 to U+00FF
    kind[latin] = kind[latin + 1] = LETTER
    starts, ends = tokens(kind, np.minimum(np.arange(256), 1).astype(np.uint8))
    odd = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(kind == OTHER, out=odd[1:])
    bad = odd[ends] > odd[starts]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[bad]] = 1
    edge[ends[bad]] = -1
    kind = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(OTHER), kind)
    plain = np.where(kind == OTHER, data, _lower[data])
    upper = latin[(kind[latin] == LETTER) & (data[latin + 1] < 0x9F)] + 1
    plain[upper] += 0x20
    new = np.ones(len(data), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] != SPACE
    return plain, starts[real], ends[real]


def _in_chunks(table: TokenTable, texts: list[bytes], specials: list[bytes], whole):
    """(first, end, values, sizes) of ranges of texts; what whole(text) gives stands for those that hold a special string."""
    odd = [i for i, t in enumerate(texts) if any(s in t for s in specials)]
    plain = list(texts)
    for i in odd:
        plain[i] = b""
    for a, b in chunks_of(plain):
        data, begins = joined(plain[a:b])
        data, starts, ends = pre_tokens(data)
        values, counts = table.values(data, starts, ends)
        total = np.concatenate(([0], np.cumsum(counts)))
        at = np.searchsorted(starts, begins)
        sizes = total[at[1:]] - total[at[:-1]]
        own = [i for i in odd if a <= i < b]
        if own:
            more = [whole(texts[i].decode()) for i in own]
            after = np.cumsum(sizes)[[i - a for i in own]]
            values = np.insert(values, np.repeat(after, [len(x) for x in more]), np.concatenate(more))
            sizes[[i - a for i in own]] = [len(x) for x in more]
        yield a, b, values, sizes


def proven_whole(path: str, ends: str = "</w>") -> dict[str, int]:
    """The vocabulary strings that, as a pre-token alone, the library encodes as the one token itself, with its id.

    Done once, before any text is read. Strings that the normaliser changes, or that split into
    several pre-tokens, are no pre-tokens and do not qualify.
    """
    tokenizer = load(path)
    strings, ids = [], []
    from_bytes = _byte_of_char()
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if not token.endswith(ends):
            continue
        try:
            word = bytes(from_bytes[c] for c in token[: -len(ends)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and tokenizer.normalizer.normalize_str(word) == word:
            strings.append(word)
            ids.append(i)
    pieces = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s: i for s, i, e in zip(strings, ids, pieces) if e.ids == [i] and len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1}


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
"""Fixed value: the tokenizer's own split, for the `regex` module."""

_unsure = re.compile("[^\x00-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
"""Characters that versions of Unicode may class differently: runs with any are not split here."""


_plain = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@[-`{-~]+")


class PreTokens:
    """The ids of each pre-token: proven ones are looked up, only the rest is merged by the library's model, once each."""

    def __init__(self, path: str, proven: dict[str, int]):
        import regex

        self.tokenizer, self.proven = load(path), proven
        self.normal, self.merge = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.split = regex.compile(PRE_TOKENS).findall
        self.alphabet = {b: c for c, b in _byte_of_char().items()}
        self.merged: dict[str, list[int]] = {}

    def _merged(self, p: str) -> list[int]:
        out = self.merged.get(p)
        if out is None:
            out = [t.id for t in self.merge(p.encode().decode("latin-1").translate(self.alphabet))]
            if len(p) <= 64:
                if len(self.merged) >= MERGED:
                    self.merged = {}
                self.merged[p] = out
        return out

    def ids(self, run: str) -> list[int]:
        """Of a pre-token, or of a run that is not plain."""
        i = self.proven.get(run)
        if i is not None:
            return [i]
        if _plain.fullmatch(run):
            return self._merged(run)
        if _unsure.search(run):
            return self.tokenizer.encode(run, add_special_tokens=False).ids
        out = []
        for p in self.split(run.lower() if run.isascii() else self.normal(run)):
            i = self.proven.get(p)
            if i is None:
                out += self._merged(p)
            else:
                out.append(i)
        return out


class IdEncoder:
    """The ids of each text."""

    def __init__(self, path: str, proven: dict[str, int], **bounds: int):
        self.tokenizer, self.of = load(path), PreTokens(path, proven)
        self.specials = [s.encode() for s in _specials(self.tokenizer)]
        self.table = TokenTable(self._solve, **bounds)

    def _solve(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.of.ids(r) for r in new]
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def encode(self, texts: list[bytes]):
        """(first, end, ids, number of ids of each text) of ranges of the UTF-8 texts, in order."""
        yield from _in_chunks(self.table, texts, self.specials, lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32))


class Counter:
    """Tokens of each text: proven pre-tokens count one, only the rest is merged. Each is counted once."""

    def __init__(self, path: str, proven: dict[str, int], **bounds: int):
        self.tokenizer, self.of = load(path), PreTokens(path, proven)
        self.specials = [s.encode() for s in _specials(self.tokenizer)]
        self.table = TokenTable(self._solve, **bounds)

    def _solve(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(self.of.ids(r)) for r in new], dtype=np.uint32), np.ones(len(new), dtype=np.int64)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each UTF-8 text."""
        out = np.zeros(len(texts), dtype=np.int64)
        whole = lambda t: np.array([len(self.tokenizer.encode(t, add_special_tokens=False).ids)], dtype=np.uint32)
        for a, b, values, sizes in _in_chunks(self.table, texts, self.specials, whole):
            total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
            ends = np.cumsum(sizes)
            out[a:b] = total[ends] - total[ends - sizes]
        return out
