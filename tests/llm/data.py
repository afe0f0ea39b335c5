"""Small documents with the awkward cases, for comparing operators with brute force."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def documents(seed: int = 1, n: int = 60, words: int = 12) -> list[tuple]:
    """Texts of a few words that repeat often, with copies, nulls, ties and odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "ß.", "x́", "日本", "IT'S", "3,5", "<|endoftext|>"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts: list = []
    for i in range(n):
        own = [rng.choice(vocabulary) if rng.random() < 0.9 else f"u{rng.random()}" for _ in range(rng.choice([0, 1, 4, 19, 20, 21, 60, 150]))]
        if rng.random() < 0.5:
            at, a = rng.randrange(len(own) + 1), rng.randrange(40)
            own[at:at] = passage[a : a + rng.randrange(5, 60)]
        if texts and rng.random() < 0.25:
            own = (rng.choice(texts) or "").split(" ")
            if own and rng.random() < 0.6:
                own[rng.randrange(len(own))] = f"edit{i}"
        texts.append(rng.choice([" ", "\n", "  ", " "]).join(own))
    texts += [None, "", " \n\t ", "a", ".", "w1 " * 300, "ABC abc " * 40]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "b"]), None if t is None else len(t), 0.5) for i, t in zip(ids, texts)]
    return rows + [rows[3], rows[len(texts) - 7]]
