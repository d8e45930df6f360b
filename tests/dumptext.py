"""Dump text for tests, and a sequential model of reading it."""

from __future__ import annotations

import random
import re


def batch(base, count=1, pid=7, epoch=1, txn=True, control=False, time=1000, leader=5, crc=1, position=0, valid=True, horizon=""):
    return (
        f"baseOffset: {base} lastOffset: {base + max(count, 1) - 1} count: {count} baseSequence: 0 lastSequence: 1 producerId: {pid} producerEpoch: {epoch} partitionLeaderEpoch: {leader} "
        f"isTransactional: {str(txn).lower()} isControl: {str(control).lower()}{horizon} position: {position} CreateTime: {time} size: 61 magic: 2 compresscodec: none crc: {crc} isvalid: {str(valid).lower()}"
    )


def data(offset, time=1000, tail=" payload: x", keys="h1,h2", old=False):
    a, b, c, d = ("createTime", "keysize", "valuesize", "headerkeys") if old else ("CreateTime", "keySize", "valueSize", "headerKeys")
    return f"| offset: {offset} {a}: {time} {b}: 4 {c}: 10 sequence: 0 {d}: [{keys}]{tail}"


def control(offset, commit=True, time=1000, epoch=3):
    return data(offset, time, "", "") + f" endTxnMarker: {'COMMIT' if commit else 'ABORT'} coordinatorEpoch: {epoch}"


def change(offset, state, pid=7, epoch=1, tid="tx-a"):
    return data(offset, 1000, "", "") + f" key: transaction_metadata::transactionalId={tid} payload: producerId:{pid},producerEpoch:{epoch},state={state},partitions=[t-0,t-1],txnLastUpdateTimestamp=1700000000100,txnTimeoutMs=60000"


def delete(offset, tid="tx-a"):
    return data(offset, 1000, "", "") + f" key: transaction_metadata::transactionalId={tid} payload: <DELETE>"


def dump(*lines, path="/logs/orders-0/00000000000000000000.log", start=0, old=False):
    return "\n".join([f"Dumping {path}", f"{'Starting' if old else 'Log starting'} offset: {start}", *lines, ""])


def state(pid, epoch=1, first="None", coordinator=3, last=None):
    return f"producerId: {pid} producerEpoch: {epoch} coordinatorEpoch: {coordinator} currentTxnFirstOffset: {first} {'' if last is None else f'lastTimestamp: {last} '}firstSequence: 8 lastSequence: 9 lastOffset: 41 offsetDelta: 1 timestamp: 1700000000123"


def random_log(seed, files=3, batches=60):
    """(texts, transactions as a sequential reader finds them): sessions interleave and span files, times go back and forth."""
    r = random.Random(seed)
    texts, live, found, offset = [], {}, [], 0
    for f in range(files):
        lines, number, start = [], 2, offset
        for _ in range(batches):
            pid, epoch, time = r.randint(1, 4), r.randint(0, 1), r.randint(0, 10**6)
            key, kind = (pid, epoch), r.random()
            number += 1
            if kind < 0.6:
                n = r.randint(1, 3)
                lines += [batch(offset, n, pid, epoch, time=time), *[data(offset + i) for i in range(n)]]
                entry = live.setdefault(key, [0, time])
                entry[0] += 1
                number += n
            elif kind < 0.7:
                n = 1
                lines += [batch(offset, 1, pid, epoch, txn=False), data(offset)]
                number += 1
            else:
                n, commit = 1, r.random() < 0.5
                lines += [batch(offset, 1, pid, epoch, control=True, time=time), control(offset, commit)]
                number += 1
                entry = live.pop(key, None)
                found.append((pid, epoch, ("COMMITTED" if commit else "ABORTED") if entry else "EMPTY", entry[0] if entry else 0, time - entry[1] if entry else None))
            offset += n
        texts.append((f"{start:020d}.dump", dump(*lines, path=f"/logs/orders-0/{start:020d}.log", start=start)))
    found += [(*k, "OPEN", v[0], None) for k, v in live.items()]
    return texts, sorted(found, key=repr)


def headers(text):
    """(line number, base offset) of all batch lines."""
    return [(i + 1, int(re.match(r"baseOffset: (\d+)", x)[1])) for i, x in enumerate(text.split("\n")) if x.startswith("baseOffset: ")]
