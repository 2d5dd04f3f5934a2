"""Profile hidden Markov models of exon families.

A profile is three arrays: log emissions of match states (columns x 4), log
emissions of inserts, and log transitions per column. Scoring a read is a banded
dynamic program in log space, vectorised over columns with numpy and run in
Arrow batches; profiles are small, counted and broadcast by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
BACKGROUND = 0.25
NEG = -1e30
CODE = {b: i for i, b in enumerate(BASES)}
# Transitions where nothing is observed, in the order M->M, M->I, M->D, I->M, I->I, D->M, D->D; the
# least probability of a base or transition.
DEFAULT_TRANSITIONS = np.log(np.array([0.95, 0.025, 0.025, 0.5, 0.5, 0.95, 0.05]))
FLOOR = 0.001


@dataclass(frozen=True)
class Profile:
    match: np.ndarray
    insert: np.ndarray
    trans: np.ndarray

    @property
    def columns(self) -> int:
        return len(self.match)


def encode(seq: str) -> np.ndarray:
    """Codes 0-3; anything else is -1."""
    return np.array([CODE.get(c, -1) for c in seq.upper()], dtype=np.int64)


def from_sequence(seq: str, error: float = FLOOR) -> Profile:
    """A profile of one sequence: the base with 1 - 3 error, others (all, where it is unknown) error."""
    m = np.full((len(seq), 4), np.log(error))
    for i, c in enumerate(encode(seq)):
        if c >= 0:
            m[i, c] = np.log(1 - 3 * error)
    return Profile(m, np.full((len(seq), 4), np.log(BACKGROUND)), np.tile(DEFAULT_TRANSITIONS, (len(seq), 1)))


def _counts(rows: Sequence[str]) -> np.ndarray:
    """Bases of an alignment: columns x 4, gaps and unknown bases left out."""
    upper = [r.upper() for r in rows]
    return np.array([[sum(r[j] == b for r in upper) for b in BASES] for j in range(len(rows[0]))], dtype=float).reshape(-1, 4)


def _emissions(p: np.ndarray) -> np.ndarray:
    """Logarithms of rows with the floor, normalised."""
    p = np.maximum(p, FLOOR)
    return np.log(p / p.sum(axis=1, keepdims=True))


def from_alignment(rows: Sequence[str]) -> Profile:
    """A profile of aligned sequences.

    Columns with gaps in fewer than half of the rows are match columns. Emissions mix the
    family's composition with weight 1 / (1 + n); inserts emit by it. Transitions are counted
    between neighbouring match columns (a base between them is an insert) with the floor as
    pseudo-count; the moves out of a match where none is seen are the default ones."""
    n = len(rows)
    counts = _counts(rows)
    keep = [j for j in range(len(counts)) if 2 * sum(r[j] == "-" for r in rows) < n]
    family = counts.sum(axis=0) / max(counts.sum(), 1)
    alpha = 1 / (1 + n)
    seen = counts[keep]
    m = _emissions(alpha * family + (1 - alpha) * seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    trans = np.empty((len(keep), 7))
    for i, j in enumerate(keep):
        c = np.zeros(7)
        if i + 1 < len(keep):
            nxt = keep[i + 1]
            for r in rows:
                here, there, between = r[j] != "-", r[nxt] != "-", any(x != "-" for x in r[j + 1 : nxt])
                if between:
                    c[1] += here
                    c[3] += there
                else:
                    c[(0 if there else 2) if here else (5 if there else 6)] += 1
        for lo, hi in ((0, 3), (3, 5), (5, 7)):
            part = c[lo:hi]
            if lo == 0 and not part.sum():
                trans[i, lo:hi] = DEFAULT_TRANSITIONS[lo:hi]
            else:
                trans[i, lo:hi] = np.log((part + FLOOR) / (max(part.sum(), 1) + FLOOR * (hi - lo)))
    return Profile(m, np.tile(np.log(np.maximum(family, FLOOR)), (len(keep), 1)), trans)


def of_copy(rows: Sequence[str], copy: int, alpha: float = 0.7) -> Profile:
    """The profile of one row of an alignment on its own columns: its base with weight ``alpha``, the
    bases of all rows in the column with the rest."""
    counts = _counts(rows)
    own = encode(rows[copy])
    keep = [j for j, c in enumerate(rows[copy]) if c != "-"]
    seen = counts[keep]
    m = (1 - alpha) * seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    for i, j in enumerate(keep):
        if own[j] >= 0:
            m[i, own[j]] += alpha
    return Profile(_emissions(m), np.full((len(keep), 4), np.log(BACKGROUND)), np.tile(DEFAULT_TRANSITIONS, (len(keep), 1)))


def tilted(profile: Profile, seq: str, alpha: float = 0.7) -> Profile:
    """Emissions of a shared profile drawn towards one copy: alpha times its bases plus the rest of the profile."""
    m = np.exp(profile.match) * (1 - alpha)
    for i, c in enumerate(encode(seq)[: profile.columns]):
        if c >= 0:
            m[i, c] += alpha
        else:
            m[i] = np.exp(profile.match[i])
    return Profile(np.log(m), profile.insert, profile.trans)


def forward(profile: Profile, read: np.ndarray, entry: np.ndarray | None = None, band: int | None = 100) -> np.ndarray:
    """Log probability of leaving the last column after each read position.

    ``entry`` holds log probabilities of entering at each position (default: at 0).
    Within ``band`` of the diagonal that joins the first and last entry; a base
    that is not A, C, G or T can't be emitted. Rows are read positions.
    """
    n, k = len(read), profile.columns
    if entry is None:
        entry = np.full(n + 1, NEG)
        entry[0] = 0.0
    live = np.flatnonzero(entry > NEG / 2)
    out = np.full(n + 1, NEG)
    if not len(live) or k == 0:
        return entry.copy() if k == 0 else out
    lo, hi = live[0], live[-1]
    mm, mi, md, im, ii, dm, dd = (profile.trans[:, x] for x in range(7))
    # column by column; vectors over read positions. A column's M and D come from the column before
    pm, pi, pd_ = entry.copy(), np.full(n + 1, NEG), np.full(n + 1, NEG)
    emit_ok = np.concatenate([[False], read >= 0])
    codes = np.concatenate([[0], np.maximum(read, 0)])
    for j in range(k):
        t = j - 1
        if j == 0:
            into_m, into_d = pm, pm + np.log(0.01)
        else:
            into_m = np.logaddexp(np.logaddexp(pm + mm[t], pi + im[t]), pd_ + dm[t])
            into_d = np.logaddexp(pm + md[t], pd_ + dd[t])
        cm = np.full(n + 1, NEG)
        cm[1:] = np.where(emit_ok[1:], into_m[:-1] + profile.match[j, codes[1:]], NEG)
        cd = into_d.copy()
        ci = np.full(n + 1, NEG)
        if band is not None:
            a, b = max(0, lo + j + 1 - band), min(n, hi + j + 1 + band)
            mask = np.ones(n + 1, bool)
            mask[a : b + 1] = False
            cm[mask] = NEG
            cd[mask] = NEG
        else:
            a, b = 0, n
        x = NEG
        ins = profile.insert[j]
        start = cm + mi[j]
        for r in range(max(a, 1), b + 1):
            x = np.logaddexp(start[r - 1], x + ii[j]) + ins[codes[r]] if emit_ok[r] else NEG
            ci[r] = x
        pm, pi, pd_ = cm, ci, cd
    return np.logaddexp(np.logaddexp(pm, pi), pd_)


def log_likelihood(profile: Profile, seq: str, band: int | None = None) -> float:
    """Log likelihood of a whole read under one profile."""
    r = encode(seq)
    return float(forward(profile, r, band=band)[len(r)])


def score_many(profile: Profile, seqs: Sequence[str], cells: int = 2_000_000) -> list[float]:
    """V22 for many reads at once: their log likelihoods under one profile, unbanded.

    Reads are laid side by side, shorter ones padded behind, which no earlier position sees.
    An insert run is a first-order recurrence in log space; taken off its own running sum it
    becomes a running logsumexp. Reads with unknown bases go one by one."""
    out = [0.0] * len(seqs)
    reads = [encode(s) for s in seqs]
    plain = [i for i, r in enumerate(reads) if not (r < 0).any()]
    for i in set(range(len(seqs))) - set(plain):
        out[i] = log_likelihood(profile, seqs[i])
    plain.sort(key=lambda i: len(reads[i]))
    at = 0
    while at < len(plain):
        end = at + 1
        while end < len(plain) and (end + 1 - at) * (len(reads[plain[end]]) + 1) <= cells:
            end += 1
        part = plain[at:end]
        n = len(reads[part[-1]])
        codes = np.zeros((len(part), n), np.int64)
        for k, i in enumerate(part):
            codes[k, : len(reads[i])] = reads[i]
        pm = np.full((len(part), n + 1), NEG)
        pm[:, 0] = 0.0
        pi, pd_ = np.full_like(pm, NEG), np.full_like(pm, NEG)
        mm, mi, md, im, ii, dm, dd = (profile.trans[:, x] for x in range(7))
        for j in range(profile.columns):
            t = j - 1
            into_m = pm if j == 0 else np.logaddexp(np.logaddexp(pm + mm[t], pi + im[t]), pd_ + dm[t])
            into_d = pm + np.log(0.01) if j == 0 else np.logaddexp(pm + md[t], pd_ + dd[t])
            cm = np.full_like(pm, NEG)
            cm[:, 1:] = into_m[:, :-1] + profile.match[j][codes]
            steps = np.zeros_like(pm)
            steps[:, 1:] = np.cumsum(profile.insert[j][codes] + ii[j], axis=1)
            ci = np.full_like(pm, NEG)
            ci[:, 1:] = np.logaddexp.accumulate(cm[:, :-1] + mi[j] - steps[:, :-1] - ii[j], axis=1) + steps[:, 1:]
            pm, pi, pd_ = cm, ci, into_d
        last = pm if profile.columns == 0 else np.logaddexp(np.logaddexp(pm, pi), pd_)
        for k, i in enumerate(part):
            out[i] = float(last[k, len(reads[i])])
        at = end
    return out


def family_forward(nodes: Sequence[Profile], edges: dict[tuple[int, int], float], seq: str, band: int | None = None) -> float:
    """Log likelihood of a read over a graph of profiles in topological order.

    Sources enter at read position 0; an edge weighs the logarithm of its support
    relative to the strongest one; the result is the best exit at the read's end."""
    r = encode(seq)
    top = max(edges.values(), default=1.0)
    into: dict[int, list[tuple[int, float]]] = {}
    for (u, v), s in edges.items():
        into.setdefault(v, []).append((u, np.log(max(s, 1e-9) / top)))
    exits: list[np.ndarray] = []
    best = NEG
    for v, p in enumerate(nodes):
        if v in into:
            entry = np.full(len(r) + 1, NEG)
            for u, w in into[v]:
                entry = np.logaddexp(entry, exits[u] + w)
        else:
            entry = None
        exits.append(forward(p, r, entry, band))
        best = max(best, float(exits[v][len(r)]))
    return best


def viterbi(profile: Profile, seq: str) -> tuple[float, str]:
    """Best path through one profile as a string of M, I, D and its log probability."""
    read = encode(seq)
    n, k = len(read), profile.columns
    score = np.full((3, k + 1, n + 1), NEG)
    back = np.zeros((3, k + 1, n + 1), dtype=np.int8)
    score[0, 0, 0] = 0.0
    tr = profile.trans
    for j in range(1, k + 1):
        t = max(j - 2, 0)
        first = j == 1
        for i in range(n + 1):
            if i and read[i - 1] >= 0:
                c = [score[0, j - 1, i - 1] + (0 if first else tr[t, 0]), score[1, j - 1, i - 1] + tr[t, 3], score[2, j - 1, i - 1] + tr[t, 5]]
                b = int(np.argmax(c))
                score[0, j, i], back[0, j, i] = c[b] + profile.match[j - 1, read[i - 1]], b
                c = [score[0, j, i - 1] + tr[j - 1, 1], score[1, j, i - 1] + tr[j - 1, 4]]
                b = int(np.argmax(c))
                score[1, j, i], back[1, j, i] = c[b] + profile.insert[j - 1, read[i - 1]], b
            c = [score[0, j - 1, i] + (np.log(0.01) if first else tr[t, 2]), NEG, score[2, j - 1, i] + tr[t, 6]]
            b = int(np.argmax(c))
            score[2, j, i], back[2, j, i] = c[b], b
    s = int(np.argmax(score[:, k, n]))
    best, j, i, path = float(score[s, k, n]), k, n, []
    while j > 0:
        path.append("MID"[s])
        b = int(back[s, j, i])
        if s == 0:
            j, i = j - 1, i - 1
        elif s == 1:
            i -= 1
        else:
            j -= 1
        s = b
    return best, "".join(reversed(path))


def score_reads(reads: DataFrame, models: dict[str, Profile], seq: str = "seq", ident: str = "read", band: int | None = None, most_columns: int = 2_000_000) -> DataFrame:
    """(read, copy, loglik) of every read under every model, in Arrow batches, unbanded
    unless a ``band`` is given (a narrow one changes the score of reads with long inserts).

    Models go out by broadcast; their columns are counted and must not exceed
    ``most_columns``. Null sequences have null scores."""
    if sum(m.columns for m in models.values()) > most_columns:
        raise ValueError("too many model columns to broadcast; score families in parts")
    held = reads.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ms = sorted(held.value.items())
        for b in batches:
            texts = [s or "" for s in b["__s"]]
            for c, m in ms:
                got = score_many(m, texts) if band is None else [log_likelihood(m, s, band) for s in texts]
                yield pd.DataFrame({"read": b["__r"], "copy": c, "loglik": [None if s is None else x for s, x in zip(b["__s"], got)]}).astype({"loglik": "float64"})

    kind = reads.schema[ident].dataType.simpleString()
    return reads.select(F.col(ident).alias("__r"), F.col(seq).alias("__s")).mapInPandas(run, f"read {kind}, copy string, loglik double")


def hmm_weights(scores: DataFrame, priors: DataFrame, gap: float = 10.0) -> DataFrame:
    """V4 (E step): softmax of log-likelihood plus log prior per read. A read whose best two
    scores differ by less than ``gap`` keeps weight only as the softmax says; above it the
    best copy takes all."""
    x = scores.join(priors, "copy").withColumn("__s", F.col("loglik") + F.log("prior"))
    best = x.groupBy("read").agg(F.max("__s").alias("__b"))
    x = x.join(best, "read").withColumn("__e", F.exp(F.col("__s") - F.col("__b")))
    z = x.groupBy("read").agg(F.sum("__e").alias("__z"), F.max(F.when(F.col("__s") < F.col("__b"), F.col("__s"))).alias("__second"))
    y = x.join(z, "read")
    clear = F.col("__second").isNotNull() & (F.col("__b") - F.col("__second") >= gap)
    w = F.when(clear, F.when(F.col("__s") == F.col("__b"), 1.0).otherwise(0.0)).otherwise(F.col("__e") / F.col("__z"))
    return y.select("read", "copy", w.alias("weight"))


def family_profiles(members: DataFrame) -> DataFrame:
    """Per family its copies aligned: family, n_copies, identity, conserved, majority,
    polymorphic and indel columns, columns of the shared profile, copy_specific. ``members``: family,
    copy, seq. A fold holds the distinct copies of one family; null and empty sequences don't count."""
    from splicelake.operators import structures as S
    from splicelake.operators.folding import fold_groups, key_schema

    m = members.where("seq IS NOT NULL AND seq <> ''").groupBy("family", "copy").agg(F.min("seq").alias("seq"))

    def run(rows):
        rows_ = S.align_many([r["seq"] for r in rows])
        stats = S.column_stats(rows_)
        shared, _, specific = S.fit_profiles({str(r["copy"]): r["seq"] for r in rows})
        yield rows[0]["family"], len(rows), S.identity(rows_), stats["conserved"], stats["majority"], stats["polymorphic"], stats["indel"], shared.columns, specific

    cols = "n_copies int, identity double, conserved int, majority int, polymorphic int, indel int, columns int, copy_specific boolean"
    return fold_groups(m, ["family"], ["copy"], run, f"{key_schema(members, ['family'])}, {cols}")
