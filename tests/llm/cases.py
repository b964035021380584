"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
import re
import string

WORDS = [a + b for a in "ka lo mi re tu sa ne po vi zu".split() for b in "an or il es um".split()]
# names that the operators use themselves
CLASHING = ["run", "row", "key", "h", "n", "digest", "tail", "task", "root", "epoch", "text_sha256"]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Ids and texts: prose, copies, near copies in chains, shared passages, short, empty, null and long ones."""
    rng = random.Random(seed)
    passage, line = prose(rng, 60), prose(rng, 12)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    out = list(base)
    out += [b.upper() if i % 2 else b for i, b in enumerate(base[:6])]
    for b in base[:12]:
        chain = b
        for _ in range(3):
            chain = edited(rng, chain, 1 + len(chain.split(" ")) // 60)
            out.append(chain)
    out += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(8)]
    out += [line + "\n" + prose(rng, 40) for _ in range(12)]
    out += ["", None, " ", "one", "One", "one two", "ÄÖ äö ÄÖ äö", "ab " * 400, "\n\n\n", "Σΐ <|endoftext|>  x", "x" * 300]
    out.append(prose(rng, 6000))
    rng.shuffle(out)
    rows: list[tuple[int | None, str | None]] = list(enumerate(out))
    rows += [rows[3], rows[3], (None, out[5]), (None, None), (rows[7][0], "another text under an id that is taken")]
    return rows


def table(spark, rows, **more):
    """documents with extra columns of clashing names."""
    full = [(i, t, "en" if k % 3 else None, f"src{k % 5}" if k % 7 else None, len(t or ""), *["?"] * len(CLASHING))
            for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(full, schema).repartition(3)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None, size: int) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def as_text(rows) -> list[str]:
    return sorted(str(tuple(r)) for r in rows)
