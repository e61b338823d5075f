"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

END = 2


@cache
def encoder(path: str | None = None, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids, as tokenizers gives them without added special tokens.

    The same vocabulary's rank file, read by tiktoken, gives the same ids several times faster (asserted in the tests); texts
    that hold a special token's own string go to tokenizers, which has rules for it.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or public.path("byte_bpe_50k.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path or public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode
