import random

import pytest

NAMES = ["Brofiagladra", "Kekikapon", "Zoziazepei", "Tiabrilu", "Morgodrel"]
WORDS = "amber anvil barn basalt beacon brass canyon cedar chalk cliff cobalt copper coral cradle crystal dune ember fable fern flint forge fresco garnet glade harbour heron hollow indigo ivory jade juniper kettle lagoon lantern lilac linen marble meadow mirror mosaic moss nebula oak ochre onyx orchard otter pearl pebble pewter pine plum quartz raven reef ridge river rust saffron sage sail scarlet sepia shore silk slate smoke spruce stone stream summit teal thistle thorn tide timber topaz tower umber valley velvet vine violet walnut wharf willow window wren zinc".split()


@pytest.fixture(scope="session")
def prompts():
    """(row_id, text, split): random captions, with copies, edits, insertions, omissions and reorderings."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([5, 6, 7, 8, 12, 20, 40])
        own = rng.sample(WORDS, n - 1) + [rng.choice(NAMES) + str(rng.randrange(40))]
        rows.append(own)
        for _ in range(rng.choice([0, 0, 1, 2])):
            new = list(own)
            for _ in range(rng.randrange(1, 1 + max(1, n // 5))):
                how = rng.randrange(4)
                if how == 0:
                    new[rng.randrange(len(new))] = rng.choice(WORDS)
                elif how == 1:
                    new.insert(rng.randrange(len(new)), rng.choice(WORDS))
                elif how == 2 and len(new) > 5:
                    new.pop(rng.randrange(len(new)))
                else:
                    rng.shuffle(new)
            rows.append(new)
        if rng.random() < 0.1:
            rows.append(list(own))
    out = []
    for i, ws in enumerate(rows):
        text = ", ".join(ws)
        out.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text, rng.choice(["train", "train", "train", "val", "test", None])))
    return out
