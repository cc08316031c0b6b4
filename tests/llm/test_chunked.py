import random

import numpy as np
import pyarrow as pa

from quarrystone.llm import chunked


def deal(rows, keys):
    groups = {}
    for row in rows:
        groups.setdefault(keys(row), []).append(row)
    return [chunked._table(own) for own in groups.values()]


def plain(table):
    return list(zip(*[table[n].to_pylist() for n in ("sender", "kind", "path", "body")], strict=True))


def test_bodies_reach_their_bucket_and_marks_come_back():
    rng = random.Random(4)
    for bits, levels in ((1, 1), (1, 3), (2, 2), (2, 4), (5, 2)):
        space = chunked.Space(10 << (bits * levels), bits, 10)
        assert space.levels == levels
        sent = {}
        for chunk in range(23):
            for kind in (0, 2):
                for bucket in rng.sample(range(1 << (bits * levels)), k=min(9, 1 << (bits * levels))):
                    sent[chunk, kind, bucket] = rng.randbytes(rng.randrange(30))
        rows = []
        for chunk in range(23):
            own = space.rows(chunk, [(k, b, body) for (c, k, b), body in sent.items() if c == chunk])
            assert len(own) <= 2 * (1 << bits)
            rows += own
        for level in range(1, levels):
            tables = deal(rows, lambda r: (r[1], r[2], r[0] >> bits))
            outs = [plain(space.lift(level)(t)) for t in tables]
            assert all(len(out) <= 1 << bits for out in outs)
            rows = [r for out in outs for r in out]
        back, arrived = [], {}
        for table in deal(rows, lambda r: (r[1], r[2])):
            bodies, path, kind = table["body"].to_pylist(), table["path"][0].as_py(), table["kind"][0].as_py()
            leaves = [x for b in bodies for x in space.leaves(b)]
            arrived[kind, path] = sorted(leaves)
            marks = iter([b"m" + x for x in leaves])
            back += [(s, kind, path, space.like(b, marks)) for s, b in zip(table["sender"].to_pylist(), bodies, strict=True)]
        want = {}
        for (_, kind, bucket), body in sent.items():
            want.setdefault((kind, bucket), []).append(body)
        assert arrived == {k: sorted(v) for k, v in want.items()}
        for level in range(levels - 1, 0, -1):
            back = [r for t in deal(back, lambda r: (r[1], r[2] >> bits, r[0])) for r in plain(space.lower(level)(t))]
        for chunk in range(23):
            own = [r for r in back if r[0] == chunk]
            assert space.found([r[1] for r in own], [r[2] for r in own], [r[3] for r in own]) == {(k, b): b"m" + body for (c, k, b), body in sent.items() if c == chunk}


def test_keys_are_split_by_their_first_bits_and_marked():
    space = chunked.Space(1000, 2, 100)
    keys = np.array([1 << 63, 5, 1 << 63, 7 << 60, 5, 2**64 - 1], np.uint64)
    for more in (None, np.array([1, 2, 3, 4, 2, 6], np.uint64)):
        own = chunked.Keys(keys, space, more)
        assert len(own.keys) == (4 if more is None else 5)
        parts = list(own.split(3, np.arange(len(own.keys), dtype="<u4")))
        assert [b for _, b, _ in parts] == [0, 7, 8, 15]
        found = {(3, b): np.packbits(np.frombuffer(x, "<u4") % 2 == 1).tobytes() for _, b, x in parts}
        assert own.marks(3, found).tolist() == [i % 2 == 1 for i in range(len(own.keys))]
    assert list(chunked.Keys(np.zeros(0, np.uint64), space).split(0, np.zeros(0, "<u4"))) == []
    assert chunked._table([]).num_rows == 0 and isinstance(chunked._table([]), pa.Table)
