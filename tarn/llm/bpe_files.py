"""Where the public vocabulary files are, and encoders made from them."""

from __future__ import annotations

import base64
import functools

END_OF_TEXT = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids of texts, as the tokenizers library gives them for
    ``<stem>.json`` without added special tokens.

    The same vocabulary stands in ``<stem>.tiktoken``; its encoder is some four
    times faster and takes over, and the library itself encodes the texts that
    the fast encoder refuses (such as very long runs of white space).
    """

    def __init__(self, stem: str = "byte_bpe_50k"):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(vocabulary(f"{stem}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._fast = tiktoken.Encoding(stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self._stem = stem
        self.n_ids = len(ranks) + 1

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary(f"{self._stem}.json"))

    def encode(self, text: str):
        try:
            return self._fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the encoder's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            import numpy as np

            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(stem: str = "byte_bpe_50k") -> Encoder:
    """One encoder per worker process."""
    return Encoder(stem)
