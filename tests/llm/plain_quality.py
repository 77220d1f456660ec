"""Perplexities from a dictionary of grams, letter by letter."""

import math

from tempora.llm import quality


def gram_of(number):
    return (number % 2**64).to_bytes(8, "big").decode("utf-16-be", "surrogatepass").lstrip("\0")


def number_of(gram):
    return int.from_bytes(gram.encode("utf-16-be", "surrogatepass"), "big")


def table_of(model, lang):
    return {gram_of(r["gram"]): (r["p"], r["back"]) for r in model.table.filter(model.table["lang"] == lang).collect()}


def grams(text, order):
    for word in quality.normal(text).split():
        padded = f" {word} "
        yield [padded[max(0, i - order + 1) : i + 1] for i in range(1, len(padded))]


def cost(table, gram):
    p = table.get(gram, (None, None))[0]
    if p is not None or not gram:
        return -math.log(p or 1e-6)
    return cost(table, gram[1:]) - math.log((table.get(gram[:-1]) or (0, 1.0))[1] or 1.0)


def text(table, text, order):
    """(mean, mean of the worst words) of surprisal per character; None without words."""
    words = [(sum(cost(table, g) for g in word), len(word)) for word in grams(text, order)]
    if not words:
        return None
    worst = sorted(c / n for c, n in words)[-max(1, round(quality.WORST * len(words))) :]
    return sum(c for c, _ in words) / sum(n for _, n in words), sum(worst) / len(worst)
