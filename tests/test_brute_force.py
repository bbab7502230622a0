"""Queries without SQL against plain loops over a small table of parts."""

import hashlib
import os
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from bazaarlake.plans import QUERIES
from bazaarlake.plans import fuzzy as P
from bazaarlake.sources.tables import SCHEMAS, Tables

NAMES = ("amber axe", "blue bow", "cold club", "dark dart", "elder epee", "fine flail", "grim gauntlet", "holy halberd")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table part of 96 rows: three brands, whose names share words, and four types."""
    path = str(tmp_path_factory.mktemp("small"))
    rows = [(i + 1, f"{NAMES[i % 8]} {NAMES[(i * 5 + i // 8) % 8].split()[1]}", f"Brand#{i % 3 + 1}", ("STEEL", "STANDARD", "PROMO", "SMALL")[i * 7 % 4], i % 50 + 1, 900.0 + i) for i in range(96)]
    spark.createDataFrame(rows, SCHEMAS["part"]).coalesce(2).write.parquet(f"{path}/part.parquet")
    return path


def common(a, b):
    """Length of the longest common subsequence, by the table of all beginnings."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


def result(spark, folder, name, *columns):
    return sorted((tuple(rounded(v) for v in r) for r in QUERIES[name](spark, folder).select(*columns).collect()), key=repr)


def want(rows):
    return sorted((tuple(rounded(v) for v in r) for r in rows), key=repr)


class Sessions:
    """The inputs of the resolutions, by session and slot, and the scores of a line with an effect."""

    def __init__(self, spark, folder):
        t = Tables(spark, folder)
        self.entries = t.sql(P._ENTRIES).collect()
        self.slots = t.sql(P._SLOTS).collect()
        self.lines, self.effects, self.known = defaultdict(list), defaultdict(list), {}
        for x in sorted(P._lines(t).collect(), key=lambda x: x["line_no"]):
            self.lines[x["session"], x["slot"]].append(x)
        for x in sorted(t.sql(P._EFFECTS).collect(), key=lambda x: x["effect_no"]):
            self.effects[x["entry"]].append(x)

    def score(self, line, effect):
        key = line["text"], effect["effect"], effect["condition"]
        if key not in self.known:
            whole = effect["effect"] if effect["condition"] is None else f"{effect['condition']} {effect['effect']}"
            self.known[key] = max(ratio(line["text"], effect["effect"]), ratio(line["text"], whole))
        return self.known[key]

    def in_turn(self, lines, entry, least):
        """(line, effect, score) of lines that take their best free effect one after another, the lower number first."""
        used, out = set(), []
        for line in lines:
            free = [(self.score(line, e), -e["effect_no"], e) for e in self.effects[entry] if e["effect_no"] not in used]
            free = [x for x in free if least(x[0])]
            if free:
                score, _, effect = max(free, key=lambda x: x[:2])
                used.add(effect["effect_no"])
                out.append((line, effect, score))
        return out

    def total(self, lines, entry):
        """Score of the pairs above 50, taken from the best down."""
        pairs = [(self.score(x, e), x["line_no"], e["effect_no"]) for x in lines for e in self.effects[entry]]
        seen, total = (set(), set()), 0.0
        for score, line, effect in sorted(pairs, reverse=True):
            if score > 50 and line not in seen[0] and effect not in seen[1]:
                seen[0].add(line), seen[1].add(effect)
                total += score
        return total

    def evidence(self):
        for x in self.slots:
            lines = self.lines[x["session"], x["slot"]]
            mine = [e for e in self.entries if e["slot"] == x["slot"]]
            names = {e["entry"]: ratio(x["header"], e["name"]) for e in mine}
            top = max(names.values(), default=0)
            ranked = sorted((-self.total(lines, e), -s, e) for e, s in names.items() if s >= 30 and s >= top - 15)
            alone = min(((-self.total(lines, e), e) for e in names), default=(0, None))
            effects, name, entry = (-ranked[0][0], -ranked[0][1], ranked[0][2]) if ranked else (None, None, None)
            row = (None, name, effects, None)
            if effects and (name >= 80 or effects >= 120):
                row = (entry, name, effects, "evidence")
            elif not effects and -alone[0] >= 100:
                row = (alone[1], name, -alone[0], "effects")
            elif name is not None and name >= 80:
                row = (entry, name, effects, "name")
            yield (x["session"], x["slot"], *row)


@pytest.fixture(scope="module")
def sessions(spark, folder):
    return Sessions(spark, folder)


def test_er_evidence(spark, folder, sessions):
    rows = list(sessions.evidence())
    assert result(spark, folder, "er_evidence", "session", "slot", "entry", "name_score", "effect_score", "how") == want(rows)
    assert len({r[5] for r in rows}) > 1


def test_er_by_effects(spark, folder, sessions):
    rows = []
    for (session, slot), lines in sessions.lines.items():
        for of in (slot, 1 - slot):
            found = []
            for e in sessions.entries:
                n = len(sessions.effects[e["entry"]])
                if e["slot"] == of and n:
                    per = sum(x[2] for x in sessions.in_turn(lines, e["entry"], lambda s: s > 60)) / n
                    found += [(-per, e["entry"])] if per >= 50 else []
            if found:
                rows.append((session, slot, min(found)[1], -min(found)[0]))
                break
    assert result(spark, folder, "er_by_effects", "session", "slot", "entry", "per_effect") == want(rows)


def test_er_template_effects(spark, folder, sessions):
    """Lines in order with their effects, and the entry's other effects without a line."""
    rows = []
    for session, slot, entry, *_ in sessions.evidence():
        if entry is not None:
            taken = {e["effect_no"]: x["line_no"] for x, e, _ in sessions.in_turn(sessions.lines[session, slot], entry, lambda s: s >= 50)}
            rows += [(session, slot, entry, e["effect_no"], taken.get(e["effect_no"])) for e in sessions.effects[entry]]
    assert rows and result(spark, folder, "er_template_effects", "session", "slot", "entry", "effect_no", "line_no") == want(rows)


def test_er_priority(spark, folder, sessions):
    """The item's name, else the header, else what the evidence says: the first that the dictionary of the slot knows."""
    known = {(e["slot"], e["name"]): e["entry"] for e in sessions.entries}
    by_id = {e["entry"]: e["name"] for e in sessions.entries}
    truth = {r["line_id"]: r["gt"] for r in Tables(spark, folder).noisy_lines.collect()}
    rows = []
    for x, found in zip(sessions.slots, sessions.evidence(), strict=True):
        session, slot = x["session"], x["slot"]
        item = f"Brand#{session % 5 + 1} LARGE" if session % 7 == 0 else min(truth[y["line_no"]] for y in sessions.lines[session, slot])
        names = [("item_name", item), ("header", x["header"])] + ([("evidence", by_id[found[2]])] if found[2] is not None else [])
        source, name = next(((s, n) for s, n in names if (slot, n) in known), (None, None))
        rows.append((session, slot, name, source, len(names)))
    assert result(spark, folder, "er_priority", "session", "slot", "name", "source", "n_candidates") == want(rows)


def compared(spark, folder):
    for r in Tables(spark, folder).noisy_lines.collect():
        if not r["skipped"]:
            yield r, r["text"] == r["gt"], SequenceMatcher(None, r["text"], r["gt"]).ratio()


def summed(spark, folder, key):
    groups = defaultdict(list)
    for x in compared(spark, folder):
        groups[key(x[0])].append(x)
    for k, xs in groups.items():
        n = len(xs)
        yield k, n, sum(x[1] for x in xs), sum(x[2] for x in xs) / n, sum(x[0]["confidence"] for x in xs) / n, sum(x[0]["line_id"] % 4 == 1 for x in xs)


def test_accuracy(spark, folder):
    columns = ("compared", "exact", "accuracy", "confidence", "corrected")
    by_file = list(summed(spark, folder, lambda r: r["file_id"]))
    assert result(spark, folder, "agg_accuracy_file", "file_id", *columns) == want(by_file)
    sections = summed(spark, folder, lambda r: r["section"] if r["line_id"] % 11 else "(unknown)")
    assert result(spark, folder, "agg_accuracy_section", "section", *columns) == want(sections)
    every = list(compared(spark, folder))
    total = (len(every), sum(x[1] for x in every), sum(x[2] for x in every) / len(every))
    assert result(spark, folder, "agg_accuracy_total", "compared", "exact", "accuracy") == want([total])


def test_model_gate(spark, folder):
    a, b = ([x for x in compared(spark, folder) if x[0]["reader"] == r] for r in "ab")
    gains = sum(x[1] for x in b) - sum(x[1] for x in a), sum(x[2] for x in b) / len(b) - sum(x[2] for x in a) / len(a)
    row = (*gains, gains[0] >= 0 and gains[1] >= 0)
    assert result(spark, folder, "agg_model_gate", "exact_gain", "accuracy_gain", "passes") == want([row])


def test_header_partial(spark, folder):
    """The pattern whose text fits best into the line, or the line into it; ties to the first pattern; none below 50."""

    def fit(a, b):
        short, long = sorted((a, b), key=len)
        n = len(short)
        return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))

    t = Tables(spark, folder)
    patterns = sorted({r["p_type"].lower() for r in t.part.collect()})
    rows = []
    for r in t.noisy_lines.collect():
        section = r["section"].lower()
        text = (section[1:], f"x {section} y", r["text"])[r["line_id"] % 3]
        score, best = min((-fit(text, p), p) for p in patterns)
        rows.append((r["line_id"], text, best.upper() if -score >= 50 else None))
    assert result(spark, folder, "fz_header_partial", "line_id", "text", "section") == want(rows)


def test_unchanged_sources_are_skipped(spark, folder):
    files = sorted(f for f in os.listdir(f"{folder}/part.parquet") if f.endswith(".parquet"))
    each = [hashlib.sha256(open(f"{folder}/part.parquet/{f}", "rb").read()).hexdigest() for f in files]
    digest = hashlib.sha256("".join(each).encode()).hexdigest()
    assert len(files) == 2 and result(spark, folder, "ingest_skip_unchanged", "digest", "changed") == want([(digest, False), (digest, True)])
