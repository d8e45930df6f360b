"""Line grammars of log-segment and producer-snapshot dumps.

Each grammar is one anchored pattern; ``fields`` parses a line in a single regex
pass and yields its groups as an array, or a one-element array if the line does
not match as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator between parsed groups, and the mark in front of a line that matched.
SEP = "\u0001"

# Labels, forms and types of the dump formats.
BATCH = (
    ("baseOffset", "base_offset", "[0-9]+", "bigint"),
    ("lastOffset", "last_offset", "[0-9]+", "bigint"),
    ("count", "count", "[0-9]+", "int"),
    ("baseSequence", "base_sequence", "-?[0-9]+", "int"),
    ("lastSequence", "last_sequence", "-?[0-9]+", "int"),
    ("producerId", "producer_id", "-?[0-9]+", "bigint"),
    ("producerEpoch", "producer_epoch", "-?[0-9]+", "smallint"),
    ("partitionLeaderEpoch", "partition_leader_epoch", "[0-9]+", "int"),
    ("isTransactional", "is_transactional", "true|false", "boolean"),
    ("isControl", "is_control", "true|false", "boolean"),
    ("position", "position", "[0-9]+", "bigint"),
    ("CreateTime", "create_time", "[0-9]+", "bigint"),
    ("size", "size", "[0-9]+", "int"),
    ("magic", "magic", "[0-9]+", "tinyint"),
    ("compresscodec", "compress_codec", "none|[A-Z]+", "string"),
    ("crc", "crc", "[0-9]+", "unsigned"),
    ("isvalid", "is_valid", "true|false", "boolean"),
)
# an optional, ignored field stands before this label
DELETE_HORIZON = r"(?: deleteHorizonMs: (?:OptionalLong\.empty|[0-9]+))?"

RECORD = (
    ("offset", "offset", "[0-9]+", "bigint"),
    ("[Cc]reateTime", "create_time", "[0-9]+", "bigint"),
    ("key[Ss]ize", "key_size", "-?[0-9]+", "int"),
    ("value[Ss]ize", "value_size", "-?[0-9]+", "int"),
    ("sequence", "sequence", "-?[0-9]+", "int"),
)
HEADERS = r"header[Kk]eys: \[(.*)\](?: payload:.*)?"
CONTROL = r" endTxnMarker: (COMMIT|ABORT) coordinatorEpoch: ([0-9]+)"
STATE = r" key: transaction_metadata::transactionalId=(.*) payload: (.*)"
STATES = ("Ongoing", "PrepareCommit", "PrepareAbort", "CompleteCommit", "CompleteAbort", "Empty", "Dead")
STATE_PAYLOAD = r"\AproducerId:([0-9]+),producerEpoch:([0-9]+),state=(" + "|".join(STATES) + r"),partitions=\[(.*)\],txnLastUpdateTimestamp=([0-9]+),txnTimeoutMs=([0-9]+)\z"
DELETED = "<DELETE>"
NONE = "None"

SNAPSHOT = (
    ("producerId", "producer_id", "[0-9]+", "bigint"),
    ("producerEpoch", "producer_epoch", "[0-9]+", "smallint"),
    ("coordinatorEpoch", "coordinator_epoch", "[0-9]+", "int"),
    ("currentTxnFirstOffset", "current_txn_first_offset", r"None|Some\([0-9]+\)", "option"),
    ("lastTimestamp", "last_timestamp", "[0-9]+", "bigint"),
    ("firstSequence", "first_sequence", "[0-9]+", "int"),
    ("lastSequence", "last_sequence", "[0-9]+", "int"),
    ("lastOffset", "last_offset", "[0-9]+", "bigint"),
    ("offsetDelta", "offset_delta", "[0-9]+", "int"),
    ("timestamp", "timestamp", "[0-9]+", "bigint"),
)

# State changes; the states that may come before each state.
PREVIOUS_STATES = {
    "Ongoing": ("Ongoing", "CompleteAbort", "CompleteCommit", "Empty"),
    "PrepareCommit": ("Ongoing",),
    "PrepareAbort": ("Ongoing",),
    "CompleteCommit": ("PrepareCommit",),
    "CompleteAbort": ("PrepareAbort",),
    "Empty": ("CompleteAbort", "CompleteCommit", "Empty"),
    "Dead": ("Empty", "CompleteAbort", "CompleteCommit"),
}


def _labelled(spec) -> list[str]:
    return [f"{label}: ({form})" for label, _, form, _ in spec]


_batch = _labelled(BATCH)
BATCH_PATTERN = r"\A" + " ".join(_batch[:10]) + DELETE_HORIZON + " " + " ".join(_batch[10:]) + r"\z"
_record = r"\A\| " + " ".join(_labelled(RECORD)) + " " + HEADERS
DATA_PATTERN = _record + r"\z"
CONTROL_PATTERN = _record + CONTROL + r"\z"
STATE_PATTERN = _record + STATE + r"\z"
_snapshot = _labelled(SNAPSHOT)
SNAPSHOT_PATTERN = r"\A" + " ".join(_snapshot[:4]) + f"(?: {_snapshot[4]})? " + " ".join(_snapshot[5:]) + r"\z"

GROUPS = {BATCH_PATTERN: 17, DATA_PATTERN: 6, CONTROL_PATTERN: 8, STATE_PATTERN: 8, STATE_PAYLOAD: 6, SNAPSHOT_PATTERN: 10}


def fields(line: Column, pattern: str) -> Column:
    """Groups of ``pattern`` in ``line``, led by an empty string; an array of one element if the whole line does not match.

    A separator character inside the line makes the array longer than the grammar
    has groups, which counts as no match.
    """
    groups = "".join(f"{SEP}${i + 1}" for i in range(GROUPS[pattern]))
    return F.split(F.regexp_replace(line, pattern, groups), SEP)


def matched(parsed: Column, pattern: str) -> Column:
    return F.size(parsed) == GROUPS[pattern] + 1


def signed32(value: Column) -> Column:
    """An unsigned 32-bit number as the signed integer of the same bits; null beyond 32 bits."""
    wide = value.cast("bigint")
    wrapped = F.pmod(wide + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.when(wide.between(0, 4294967295), wrapped).cast("int")


def typed(parsed: Column, spec, at: int = 1) -> list[Column]:
    """Typed columns of consecutive groups; a number that does not fit its type is null."""
    out = []
    for i, (_, name, _, kind) in enumerate(spec):
        raw = F.get(parsed, F.lit(at + i))
        if kind == "unsigned":
            value = signed32(raw.try_cast("bigint"))
        elif kind == "option":
            value = F.when(raw.isNull() | (raw == NONE), F.lit(0).cast("bigint")).otherwise(F.regexp_extract(raw, "([0-9]+)", 1).try_cast("bigint"))
        elif kind == "string":
            value = raw
        else:
            value = raw.try_cast(kind)
        out.append(value.alias(name))
    return out


def bad_number(parsed: Column, spec, at: int = 1) -> Column:
    """The first group that is a number its type cannot hold, as text; null if there is none."""
    digits = lambda raw, kind: F.regexp_extract(raw, "([0-9]+)", 1) if kind == "option" else raw
    numbers = [(digits(F.get(parsed, F.lit(at + i)), kind), value) for i, ((_, _, _, kind), value) in enumerate(zip(spec, typed(parsed, spec, at), strict=True)) if kind not in ("string", "boolean")]
    return F.coalesce(*[F.when((F.coalesce(raw, F.lit("")) != "") & value.isNull(), raw) for raw, value in numbers])
