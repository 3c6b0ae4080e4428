import re

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    seen, dup, lost, kept_lines = set(), 0, 0, []
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        if n:
            dup += line in seen
            seen.add(line)
        few = n >= quality.MANY and not re.search(quality.SENTENCE, line)
        noisy = sum(c in quality.SYMBOLS for c in line) * 10 > 3 * n or n >= quality.MANY and line.count("!") * 10 > 3 * n
        bars = sum(c in quality.SEPARATORS for c in line)
        menu = bars >= 3 and bars * 4 >= n or n <= quality.FEW and re.search(quality.NAVIGATION, line)
        if n and (few or noisy or menu or n <= quality.LONG and re.search(quality.BOILERPLATE, line)):
            lost += n
        else:
            kept_lines.append(line)
    n = len(words)
    base = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(covered), base, not base and 100 * lost <= 50 * n, "\n".join(kept_lines))


CASES = [
    None, "", "   \n\t ", "a", "a b", "a b c a b c", "x " * 200, "one two three four five " * 30 + ".",
    "\n".join(f"Line {i} has some words in it, éß." for i in range(20)),
    "\n".join(["Home | About | News | Contact | More"] * 3 + [f"A real sentence number {i} with twelve words to read on here." for i in range(12)]),
    "Licensed under the X License.\n" + " ".join(f"w{i}" for i in range(80)) + ".\n\n",
    " ".join(f"w{i} goes on." for i in range(40)) + " See the privacy policy. " + " ".join(f"v{i} too." for i in range(40)),
    "\n".join(f"यह वाक्य {i} यहाँ समाप्त होता है।" for i in range(20)), "\n".join(f"هل هذه الجملة {i} تنتهي هنا الآن؟" for i in range(20)),
    "a b a b a b c d " + " ".join(f"u{i}." for i in range(60)), "\n".join(["Read our privacy policy. Click here!"] * 5), " ".join(f"w{i}$$$ v{i}&&&" for i in range(60)), " a b \x0b c\x0cd\re",
]


def test_rules_against_brute_force(spark):
    rows = [(i % 9 or None, t, "clash") for i, t in enumerate(CASES)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, kept string, k int")
    got = {r.k: r for r in quality.apply_rules(docs).collect()}
    for k, text in enumerate(CASES):
        r = got[k]
        cleaned = r.text if text is not None else ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, cleaned) == brute(text), text
    assert got[0].text is None
    assert quality.apply_rules(docs.limit(0)).collect() == []


def test_table_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.apply_rules(docs).drop("text").collect()}
    texts = {r.doc_id: r.text for r in docs.where("n_chars < 4000").collect()}
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(text)[:7]
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    bad = [got[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert all(r.kept for r in good if not r.base_failed)
