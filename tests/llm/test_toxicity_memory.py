"""Training of the toxicity machine keeps each string once."""
import random
import tracemalloc

from tillsight.llm import toxicity


def test_training_memory():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4000)]
    sample = [(" ".join(rng.choices(words, k=400)) + ("" if i % 2 else ". you zorglub"), 1 - i % 2) for i in range(200)]
    toxicity.train(sample[:4])
    tracemalloc.start()
    machine = toxicity.train(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20, peak
    machine.learn_words({"zorglub", words[0]})
    assert machine.margin({"zorglub"}) > machine.margin({words[0]})
