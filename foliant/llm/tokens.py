"""Public tokenizers as token offsets into the UTF-8 bytes of a text. Vocabulary files are parameters, never copied."""

from __future__ import annotations

import numpy as np


class ByteTokens:
    """One token per UTF-8 byte: the public ByT5 tokenizer without its end mark."""

    name = "bytes"

    def starts(self, text: str) -> range:
        return range(len(text.encode("utf-8", "surrogatepass")))


class FileTokens:
    """A vocabulary file of the ``tokenizers`` library, read once per Python worker."""

    _loaded: dict = {}

    def __init__(self, path: str) -> None:
        self.name = path

    def starts(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if self.name not in self._loaded:
            t = Tokenizer.from_file(self.name)
            t.encode_special_tokens = True
            self._loaded[self.name] = t
        offsets = np.array([a for a, _ in self._loaded[self.name].encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        widths = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))))
        return at[offsets] if len(offsets) else offsets


def tokenizer(name: str):
    """'bytes', or the path of a ``tokenizers`` JSON file."""
    return ByteTokens() if name == "bytes" else FileTokens(name)
