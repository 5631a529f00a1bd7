"""Invented texts for the tests of this folder."""


def prose(rng, words: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
