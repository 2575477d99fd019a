"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

Texts of Latin letters and common marks are encoded by ranks (the same vocabulary in its other file), which is about three times
as fast; the classes of their characters are the same in all versions of Unicode. All other texts are encoded by the tokenizer
itself, and so are all where the vocabulary has no file of ranks. Long texts are encoded in parts of a million characters, cut before
a single space that no pre-token crosses, so memory is bounded by the part and the ids.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Characters of a long text that are encoded at a time.
SEGMENT = 1_000_000
#: Any other character sends a text to the tokenizer: ASCII, Latin letters and marks, dashes and quotes, general marks.
UNUSUAL = re.compile("[^\t\n\r -~¡-ɏ‐-‧‰-⁞]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str) -> Iterator[str]:
    """Parts of a text, cut before single spaces between other characters."""
    start = 0
    while len(text) - start > SEGMENT:
        at = text.find(" ", start + SEGMENT)
        while 0 < at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 < at < len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranked = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            pairs = map(bytes.split, ranks.read_bytes().splitlines())
            self.ranked = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
            )

    def _ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and not UNUSUAL.search(text):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> bytes:
        if len(text) <= SEGMENT:
            return self._ids(text).astype("<u4").tobytes()
        return b"".join(self._ids(part).astype("<u4").tobytes() for part in segments(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)
