"""Token ids of whole texts by public tokenizers, remembered word by word.

The tokenizers used here never join what a single space separates: cut before every
single space between two characters that aren't white space, a text's ids are the ids
of its words in order. Words repeat, so each worker remembers a bounded number of them.
Runs of white space, and texts without any, stay whole inside a word.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

from litlake.llm.common import LOWER

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words of a vocabulary without case and white space: also cut around a stop or comma after an ASCII letter.
_MARKS = [
    (re.compile(rb"\.(?<=[a-z]\.)(?=[\sa-z]|\Z)"), b" . "),
    (re.compile(rb",(?<=[a-z],)(?=[\sa-z]|\Z)"), b" , "),
]
#: Words that a worker remembers (and as many that it remembered before), and their greatest length.
REMEMBER, LONGEST = 150_000, 64
#: Characters of text that are cut to words at a time; a longer text is cut alone.
AT_ONCE = 1 << 19


def public_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(name: str, specials_are_text: bool):
    """The named tokenizer (or that of a file with a path), loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(name if os.path.sep in name else public_path(name))
    loaded.encode_special_tokens = specials_are_text
    return loaded


@cache
def lean_tokenizer(name: str):
    """The same vocabulary for words of lower-case letters in composed form, white space between them.

    Case, composition and the cut at marks have nothing to do on such words.
    """
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = Tokenizer.from_file(name if os.path.sep in name else public_path(name))
    loaded.normalizer = normalizers.Sequence([])
    loaded.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return loaded


def is_lean(word: str) -> bool:
    """Whether ``lean_tokenizer`` gives a word's ids."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


@cache
def piece_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=name if os.path.sep in name else public_path(name))


def words(text: str) -> list[str]:
    """The text between its cuts; the space at a cut is left out."""
    return _CUT.split(text)


def lower_words(text: str) -> list[bytes]:
    """Words for a vocabulary that folds case, drops white space and keeps letters from marks.

    ASCII letters are folded before the cut, so that words repeat more. A text that
    may hold special tokens stays whole.
    """
    raw = text.encode()
    if b"<|" in raw:
        return [raw]
    raw = raw.translate(LOWER)
    for mark, apart in _MARKS:
        raw = mark.sub(apart, raw)
    return raw.split()


class Remembered:
    """What ``compute`` gives for a list of words (never None), remembered for later texts."""

    def __init__(
        self,
        compute: Callable[[list], list[Any]],
        cut: Callable[[str], list] = words,
        remember: int = REMEMBER,
    ):
        self.compute = compute
        self.cut = cut
        self.remember = remember
        self.known: dict[Any, Any] = {}
        self.older: dict[Any, Any] = {}

    def texts(self, texts: list[str]) -> Iterator[list[Any]]:
        """Per text, the results of its words in order."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> Iterator[list[Any]]:
        cut = [self.cut(t) for t in texts]
        if len(self.known) > self.remember:
            # Words that are asked for again come back from the older half; the others go.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        get = known.get
        results = [list(map(get, ws)) for ws in cut]
        unknown = {
            w for ws, r in zip(cut, results, strict=True) if None in r for w, x in zip(ws, r, strict=True) if x is None
        }
        missing = [w for w in unknown if w not in older]
        found = dict(zip(missing, self.compute(missing), strict=True)) if missing else {}
        for w in unknown:
            if w not in found:
                found[w] = older[w]
            if len(w) <= LONGEST:
                known[w] = found[w]
        for ws, r in zip(cut, results, strict=True):
            if None in r:
                r = [found[w] if x is None else x for w, x in zip(ws, r, strict=True)]
            yield r
