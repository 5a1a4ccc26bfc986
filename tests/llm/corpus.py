"""A small corpus with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

LONG = 30_000


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward():
    """doc_id -> text: nulls, empty, white space, ties, repeats, a very long text, odd characters."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("Th", "er", "on") for b in ("ing", "a", "é", "") for c in ("s", "ti", "ß", ".")]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for i in range(40)}
    line = " ".join(rng.choices(vocabulary, k=14)).replace(".", "") + "."
    passage = "\n".join(" ".join(rng.choices(vocabulary, k=12)).replace(".", "") + "." for _ in range(6))
    texts |= {40: None, 41: "", 42: "  \n\t\x0b ", 43: "a", 44: "a", 45: line, 46: f"{line}\n{line}\n\n {line.upper()}", 47: passage, 48: f"Before {passage} after all.", 49: passage + "\nx y z",
              50: " ".join(rng.choices(vocabulary, k=LONG)), 51: "x" * 3000, 52: "日本語 テスト \U0001F600 #*$%&|<> !?", 53: "<|endoftext|> <|user|>\r\n'll 12 345", 54: "loop. " * 300, 55: "İSTANBUL É\x85\x1c z w"}
    return texts


def frame(spark, texts, parts=5):
    """documents with the texts, and further columns whose names operators use inside."""
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    extra = "0 as hash, 'k' as key, 1 as n, 2 as score, 3 as unit, 4 as shard, 5 as size, 6 as row, 7 as kept, 8 as digest, 9 as copies, 'w' as word, 'w' as words, 'g' as grams"
    return docs.selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'en', if(doc_id % 3 = 1, 'fr', null)) as lang", "'src' as source", "length(text) as n_chars", *extra.split(", ")).repartition(parts)


def repeated_words(text):
    w = words(text)
    spots = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if spots[tuple(w[i:i + 3])] > 1 for k in range(3)})


def base_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(text)


def units(text, marks=".!?,;:"):
    out, start = [], 0
    for part in re.findall(rf"[^\n{marks}]*(?:\n|[{marks}]+)|[^\n{marks}]+", text or ""):
        if words(part):
            out.append((start, start + len(part), len(words(part)), " ".join(words(part)).lower()))
        start += len(part)
    return out


def repeated_runs(texts, least, marks=".!?,;:"):
    """{(doc_id, start, end): words} by looking at all units in order of doc_id and place."""
    seen, out = {}, {}
    for doc in sorted(d for d in texts if d is not None):
        run = None
        for start, end, n, norm in [*units(texts[doc], marks), (0, 0, 0, None)]:
            if norm is not None and norm in seen:
                run = (run[0], end, run[2] + n) if run else (start, end, n)
                continue
            if run and run[2] >= least:
                out[doc, run[0], run[1]] = run[2]
            run = None
            seen.setdefault(norm, (doc, start))
    return out
