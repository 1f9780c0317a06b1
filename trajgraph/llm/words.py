"""Word-wise work inside Arrow tasks: sub-batches of bounded size and a bounded table of words already seen."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from .common import by_value

by_value(__name__)

#: Characters (or bytes) of text handled at once in a task; a single longer text is handled alone.
CHUNK = 4_000_000
#: Words a task remembers, some 120 MB; at this size its table starts anew. Results do not depend on it.
REMEMBER = 600_000


def chunks(batches: Iterable, chunk: int = CHUNK) -> Iterator[tuple[list, list]]:
    """``(ids, texts as bytes)`` of Arrow batches with columns (id, text), null text as empty.

    The cycle collector rests meanwhile: word lists hold no cycles, and its passes over them cost a fifth of a task's time.
    """
    import pyarrow as pa

    gc.disable()
    try:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= chunk:
                    yield keys[at : i + 1], texts[at : i + 1]
                    at, size = i + 1, 0
            if at < len(keys):
                yield keys[at:], texts[at:]
    finally:
        gc.enable()


class WordTable(dict):
    """Word to value; one call of ``values`` fills in all new words of a chunk. ``forget`` is told when the table starts anew."""

    def __init__(self, values: Callable[[list], Iterable], limit: int = REMEMBER, forget: Callable[[], None] = lambda: None):
        super().__init__()
        self.values_of, self.limit, self.forget = values, limit, forget

    def look(self, words: list) -> list:
        """The values of ``words``, in order."""
        if len(self) > self.limit:
            self.clear()
            self.forget()
        found = list(map(self.get, words))
        holes = [i for i, v in enumerate(found) if v is None]
        if holes:
            new = list({words[i] for i in holes})
            self.update(zip(new, self.values_of(new)))
            for i in holes:
                found[i] = self[words[i]]
        return found

    def look_all(self, lists: list[list]) -> Iterator[list]:
        """:meth:`look` for a list of lists with one look at all of their words."""
        found = self.look(list(chain.from_iterable(lists)))
        at = 0
        for words in lists:
            yield found[at : at + len(words)]
            at += len(words)
