"""Conversation structure repair by a suffix-shared automaton.

A conversation's rows become a signature of one symbol per row (role initial and
fault). Signatures are read from their ends: sorted by the reversed signature,
neighbours share the longest common suffix, so the nodes of the minimised
automaton lie on one path in memory and each is worked out once. A node keeps,
for every state of the role grammar, the cost to the end and the best audit
suffix; conversations only look theirs up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import broadcast_if_small, cut_lineage

SPACE = " \t\n\x0b\x0c\r"
#: Turns of a conversation that are sorted together; longer conversations are dealt over several tasks.
BLOCK_TURNS = 256
#: Rows and characters of a segment, the unit in which texts travel.
SEGMENT_ROWS = 256
SEGMENT_CHARS = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Grammar of role initials (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
#: The state after the only user or assistant message that is allowed next.
_FREE = (2, 2, 3, 2)
_NEVER = 1 << 60


def _relaxed(cost: list[int], op: list[str]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Insertions taken where they are cheaper, or as cheap and ASCII-less."""
    changed = True
    while changed:
        changed = False
        for q in range(4):
            offer = INSERT + cost[_FREE[q]]
            if (offer, "I") < (cost[q], op[q]):
                cost[q], op[q], changed = offer, "I", True
    return tuple(cost), tuple(op)


_END = _relaxed([0, _NEVER, _NEVER, 0], ["", "~", "~", ""])


@lru_cache(maxsize=100_000)
def _costs(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost to the end and first edit for each grammar state, before a row of this symbol.

    All edits of a state start with different letters, so the least letter among
    the cheapest edits begins the least audit.
    """
    cost, op = [], []
    for q in range(4):
        offers = [(DELETE + after[q], "D")]
        if symbol != "d":
            fine = TRUNCATED if symbol.isupper() else 0
            offers.append((REROLE + fine + after[_FREE[q]], "R"))
            kept = _NEXT.get((symbol.lower(), q))
            if kept is not None:
                offers.append((fine + after[kept], "K"))
        best = min(offers)
        cost.append(best[0])
        op.append(best[1])
    return _relaxed(cost, op)


class Automaton:
    """The path of nodes of the last signature, from its end."""

    def __init__(self) -> None:
        self.read = ""  # reversed signature of the nodes on the path
        self.nodes: list[tuple[tuple[int, ...], tuple[tuple[str, tuple | None], ...]]] = []
        self.made = 0
        self._push(None)

    def _push(self, symbol: str | None) -> None:
        """Add the node in front of the path: costs, and per state an audit suffix that shares the next node's."""
        if symbol is None:
            cost, op = _END
        else:
            after, tails = self.nodes[-1]
            least = min(after)
            cost, op = _costs(symbol, tuple(c - least for c in after))
            cost = tuple(c + least for c in cost)
        suffixes = []
        for q in range(4):
            piece, at = "", q
            while op[at] == "I":
                piece, at = piece + "I", _FREE[at]
            if symbol is None:
                suffixes.append((piece, None))
                continue
            piece += op[at]
            to = at if op[at] == "D" else _FREE[at] if op[at] == "R" else _NEXT[symbol.lower(), at]
            suffixes.append((piece, tails[to]))
        self.nodes.append((cost, tuple(suffixes)))
        self.made += 1

    def solve(self, signature: str) -> tuple[int, list[str]]:
        """Least cost and the edits: one piece per row, and a last one of insertions at the end."""
        back = signature[::-1]
        if back != self.read:
            same = 0
            for x, y in zip(back, self.read):
                if x != y:
                    break
                same += 1
            del self.nodes[same + 1 :]
            for symbol in back[same:]:
                self._push(symbol)
            self.read = back
        cost, suffixes = self.nodes[-1]
        pieces, at = [], suffixes[0]
        while at is not None:
            pieces.append(at[0])
            at = at[1]
        return cost[0], pieces


def repaired(roles: list[str], texts: list[str], edits: str, state: int) -> list[str]:
    """``role:text`` of the rows after the edits, from a grammar state on."""
    lines, row = [], 0
    for edit in edits:
        if edit == "I":
            state = _FREE[state]
            lines.append("assistant:" if state == 3 else "user:")
            continue
        if edit == "R":
            state = _FREE[state]
            lines.append(f"{'assistant' if state == 3 else 'user'}:{texts[row]}")
        elif edit == "K":
            state = _NEXT[roles[row][:1], state]
            lines.append(f"{roles[row]}:{texts[row]}")
        row += 1
    return lines


def _state_after(symbols: str, pieces: list[str], state: int) -> int:
    for symbol, piece in zip(symbols, pieces):
        for edit in piece:
            state = state if edit == "D" else _NEXT[symbol.lower(), state] if edit == "K" else _FREE[state]
    return state


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes it the user's. A null conv_id or
    turn counts as one space in the sum, a null role or text is one space.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name) % 20).alias("code"),
    ).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _key(conv_id: Column) -> Column:
    """A key that is never null; null conversations are one conversation."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def segments(rows: DataFrame) -> DataFrame:
    """Segments of the conversations in order, with their rows, symbols, faults and ends.

    ``rows``: conv_id, turn, role, text (no null role or text). Rows of one
    conversation are ordered by turn (nulls first), equal turns by role and
    text. They are sorted in blocks of BLOCK_TURNS turns and read as a stream.
    """
    rows = rows.select(_key(F.col("conv_id")).alias("key"), "turn", "role", "text")
    digest = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("real"), F.col("turn").alias("turn"))
    # Texts that occur once in their conversation are no duplicates; only the others are joined back.
    repeated = rows.groupBy("key", digest.alias("digest")).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = cut_lineage(repeated.select("key", "digest", "first"), "repeated")
    rows = rows.withColumn("digest", digest).join(broadcast_if_small(repeated), ["key", "digest"], "left")
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "key", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**63))).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"), "role", "text",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("symbol"),
        (trimmed == "").alias("blank"),
        (F.col("first").isNotNull() & (F.col("first") < place)).alias("later"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "turn", "role", "text")

    def cut_up(batches) -> Iterator:
        import pyarrow as pa

        shape = pa.schema([
            ("key", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("symbols", pa.string()),
            ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("initials", pa.string()),
            ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
            ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
        ])

        def row(held) -> dict:
            turns = [t for t in held["turns"] if t is not None]
            symbols = "".join(held["symbols"])
            return {
                "key": held["key"], "block": held["block"], "part": held["part"], "symbols": symbols,
                "roles": held["roles"], "texts": held["texts"], "initials": held["initials"],
                "blank": held["blank"], "duplicate": held["duplicate"], "truncated": held["truncated"],
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            }

        held, out, chars, last = None, [], 0, None
        for batch in batches:
            for key, block, turn, role, text, symbol, blank, later, cut in zip(*[c.to_pylist() for c in batch.columns]):
                same = held is not None and (key, block) == (held["key"], held["block"])
                if not same or len(held["symbols"]) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                    if held is not None:
                        out.append(row(held))
                        if len(out) >= 64:
                            yield pa.RecordBatch.from_pylist(out, shape)
                            out = []
                    part = held["part"] + 1 if same else 0
                    held = {"key": key, "block": block, "part": part, "symbols": [], "roles": [], "texts": [], "initials": "",
                            "blank": 0, "duplicate": 0, "truncated": 0, "turns": []}
                    chars = 0
                duplicate = later or last == (key, block, turn, role, text)
                last = (key, block, turn, role, text)
                # The first fault counts.
                duplicate, cut = duplicate and not blank, cut and not blank and not duplicate
                held["symbols"].append("d" if blank or duplicate else symbol.upper() if cut else symbol)
                held["blank"] += blank
                held["duplicate"] += duplicate
                held["truncated"] += cut
                held["initials"] += role[:1] or "\0"
                held["turns"].append(turn)
                held["roles"].append(role)
                held["texts"].append(text)
                chars += len(text)
        if held is not None:
            out.append(row(held))
        if out:
            yield pa.RecordBatch.from_pylist(out, shape)

    return rows.mapInArrow(
        cut_up,
        "key string, block long, part long, symbols string, roles array<string>, texts array<string>, initials string, "
        "blank long, duplicate long, truncated long, low long, high long, turns long",
    )


def _measured(parts: DataFrame) -> DataFrame:
    """Per conversation: signature, segment lengths, counts of faults, gaps and illegal neighbours."""
    piece = F.struct("block", "part", "symbols", "initials", "low", "high")
    by_conv = parts.groupBy("key").agg(
        F.array_sort(F.collect_list(piece)).alias("p"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
    )
    initials = F.array_join(F.transform("p", lambda x: x["initials"]), "")
    # A turn that two segments share is counted in both.
    shared = F.size(F.filter("p", lambda x, i: (i > 0) & (x["low"] == F.get("p", i - 1)["high"])))
    pairs = F.sequence(F.lit(1), F.length("initials") - 1)
    illegal = F.size(F.filter(pairs, lambda i: ~F.substring(F.col("initials"), i, F.lit(2)).isin("su", "ua", "au")))
    rows = by_conv.withColumn("initials", initials).withColumn("shared", shared)
    return rows.select(
        "key", F.array_join(F.transform("p", lambda x: x["symbols"]), "").alias("signature"),
        F.transform("p", lambda x: F.struct(x["block"].alias("block"), x["part"].alias("part"), F.length(x["symbols"]).alias("n"))).alias("parts"),
        F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - F.col("shared")), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated",
        F.when(F.length("initials") > 1, illegal).otherwise(0).cast("long").alias("illegal"),
    )


def _solve(batches) -> Iterator:
    import pyarrow as pa

    part = pa.struct([("block", pa.int64()), ("part", pa.int64()), ("edits", pa.string()), ("state", pa.int32())])
    automaton = Automaton()
    for batch in batches:
        costs, audits, parts = [], [], []
        for signature, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            cost, pieces = automaton.solve(signature)
            at, state, cuts = 0, 0, []
            for p in lengths:
                own = pieces[at : at + p["n"]]
                end = at + p["n"]
                tail = pieces[-1] if p is lengths[-1] else ""
                cuts.append({"block": p["block"], "part": p["part"], "edits": "".join(own) + tail, "state": state})
                state = _state_after(signature[at:end], own, state)
                at = end
            costs.append(cost)
            audits.append("".join(pieces))
            parts.append(cuts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(parts, pa.list_(part))],
            ["key", "cost", "audit", "parts"],
        )


def _applied(batches) -> Iterator:
    """sha256 of a conversation that is one segment; the lines of a segment of a longer one."""
    import pyarrow as pa

    for batch in batches:
        shas, lines = [], []
        for roles, texts, edits, state, n in zip(*[batch.column(i).to_pylist() for i in range(3, 8)]):
            whole = "\n".join(repaired(roles, texts, edits, state))
            shas.append(hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest() if n == 1 else None)
            lines.append(None if n == 1 else whole)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(shas, pa.string()), pa.array(lines, pa.string())],
            ["key", "block", "part", "sha", "lines"],
        )


def _chained(batches) -> Iterator:
    """sha256 over the segments of each conversation, read in order; no text is kept."""
    import pyarrow as pa

    key, state, begun, out = None, None, False, []
    for batch in batches:
        for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state, begun = k, hashlib.sha256(), False
            if lines:
                state.update((b"\n" if begun else b"") + lines.encode("utf-8", "surrogatepass"))
                begun = True
    if key is not None:
        out.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], ["key", "sha"])


def repairs(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: faults of its ``rows`` and the cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. ``rows`` (conv_id, turn, role, text) is what the repair
    sees, ``original`` names the conversations. A null role or text counts as one
    space, rows with a null conv_id are one conversation, null turns come first,
    equal turns are ordered by role and text, repeated rows are adjacent.
    Without rows: zeros, an empty audit and the hash of the empty string. An
    empty table gives no rows; other columns are ignored.

    Only a conversation's symbols (a byte a row) meet in one place, because its
    audit is one string; its texts travel in segments of bounded size and are
    hashed as a stream. Conversations are sorted by their reversed signature and
    dealt by range, so every node is solved once, but for those on the path at
    the border of two ranges; equal signatures may lie in several ranges.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    parts = cut_lineage(segments(rows), "segments")
    narrow = parts.drop("roles", "texts")
    measured = cut_lineage(_measured(narrow), "signatures")
    back = F.reverse("signature")
    dealt = measured.select("key", "signature", "parts", back.alias("back"))
    dealt = dealt.repartitionByRange("back", "key").sortWithinPartitions("back", "key").drop("back")
    solved = dealt.mapInArrow(
        _solve, "key string, cost long, audit string, parts array<struct<block:long,part:long,edits:string,state:int>>"
    )
    solved = cut_lineage(solved, "solved")
    edits = solved.select("key", F.size("parts").alias("n"), F.inline("parts"))
    pieces = parts.select("key", "block", "part", "roles", "texts").join(edits, ["key", "block", "part"])
    applied = pieces.select("key", "block", "part", "roles", "texts", "edits", "state", "n").mapInArrow(
        _applied, "key string, block long, part long, sha string, lines string"
    )
    applied = cut_lineage(applied, "applied")
    long = applied.filter("sha is null").repartition("key").sortWithinPartitions("key", "block", "part")
    chained = long.select("key", "lines").mapInArrow(_chained, "key string, sha string")
    shas = cut_lineage(applied.filter("sha is not null").select("key", "sha").unionByName(chained), "hashes")
    found = measured.drop("signature", "parts").join(solved.select("key", "cost", "audit"), "key").join(shas, "key")
    names = original.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return names.join(found, "key", "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
