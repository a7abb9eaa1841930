"""Filling containers of fixed capacity with texts, by minimum bin slack.

A container starts with the longest text left; the rest of it is filled with the set of remaining lengths whose sum comes
closest to the room. Which sums can be reached is a bitset over the room - a Python integer, into which each length is
shifted, its count split in powers of two - and the chosen counts are read back from the bitsets of the steps. Texts
are dealt by hash into groups of a bounded number of texts and containers, each packed in one task, so at most one
container of a group stays partly empty for want of texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varweave.llm.tokens import count_tokens
from varweave.session import cut

CAPACITY = 4096
#: Containers and texts that one group should come to.
GROUP_CONTAINERS = 256
GROUP_TEXTS = 8192


def fill_room(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """How many of each length to take for the sum closest to the room, from the counts of what is left.

    ``order`` lists the lengths with a count, longest first.
    """
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for length in order:
        if length > room:
            continue
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
            if reach & full:
                break
        if reach & full:
            break
    target, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not target:
            break
        if not before >> target & 1:
            used[length] = used.get(length, 0) + take
            target -= length * take
    return used


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions into ``lengths``, all of them between 1 and the capacity."""
    places: dict[int, list[int]] = {}
    for at, length in enumerate(lengths):
        places.setdefault(length, []).append(at)
    for stack in places.values():
        stack.reverse()
    counts = {length: len(stack) for length, stack in places.items()}
    order = sorted(counts, reverse=True)
    containers = []
    while order:
        first = order[0]
        mine = [places[first].pop()]
        counts[first] -= 1
        for length, n in fill_room(counts, order, capacity - first).items():
            mine += [places[length].pop() for _ in range(n)]
            counts[length] -= n
        containers.append(mine)
        order = [length for length in order if counts[length]]
    return containers


def pack_documents(
    documents: DataFrame,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: tuple[str, str] | None = None,
    group_containers: int = GROUP_CONTAINERS,
    group_texts: int = GROUP_TEXTS,
) -> DataFrame:
    """(container_id, doc_id, part, first_token, n_tokens): where every token of every text goes.

    A text is split only if it is larger than a container, then into full containers and one rest. No container holds
    more than ``capacity`` tokens. Null and empty texts lie in a container of their group with no tokens. A doc_id that
    occurs in several rows is packed once per row, ``part`` counting on over equal rows; rows without an id are left out.
    An empty table gives no rows.
    """
    sized = cut(count_tokens(documents, doc_id, text, vocabulary))
    n_texts, n_tokens = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    groups = max(1, -(-n_tokens // (group_containers * capacity)), -(-n_texts // group_texts))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"])
        group = int(pdf["grp"].iloc[0])
        rows, rest, part_of = [], [], {}
        container = 0
        for d, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
            part, at = part_of.get(d, 0), 0
            while n - at > capacity:
                rows.append((container, d, part, at, capacity))
                container, part, at = container + 1, part + 1, at + capacity
            rest.append((d, part, at, n - at))
            part_of[d] = part + 1
        some = [r for r in rest if r[3]]
        for mine in pack([r[3] for r in some], capacity):
            rows += [(container, *some[i]) for i in mine]
            container += 1
        # Texts without tokens need no room.
        rows += [(max(container - 1, 0), *r) for r in rest if not r[3]]
        out = pd.DataFrame(rows, columns=["container_id", "doc_id", "part", "first_token", "n_tokens"])
        out["container_id"] += group << 32
        return out

    dealt = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, "container_id long, doc_id long, part int, first_token long, n_tokens long")
