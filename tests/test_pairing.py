import random

from tidemark.operators.pairing import Author, pairing


def run(*events):
    """(kind, anchor, source, shelf, work) of each activity; events are (uri, operation, work, shelf), r... are reviews."""
    author = Author()
    for seq, (uri, operation, work, shelf) in enumerate(events):
        author.event(seq, uri, uri[0] == "r", operation, work, shelf)
    return [x[2:] for x in author.out]


def test_review_then_item():
    assert run(("r1", "create", "w", None), ("i1", "create", "w", "complete")) == [("create", "r1", "r1", None, "w"), ("update", "r1", "r1", "complete", "w")]


def test_item_then_review():
    assert run(("i1", "create", "w", "progress"), ("r1", "create", "w", None)) == [("create", "i1", "i1", "progress", "w"), ("update", "i1", "r1", "progress", "w")]


def test_partner_deleted():
    out = run(("r1", "create", "w", None), ("i1", "create", "w", "complete"), ("i1", "delete", None, None))
    assert out[-1] == ("update", "r1", "r1", None, "w")


def test_anchor_deleted_then_partner_updated():
    out = run(("r1", "create", "w", None), ("i1", "create", "w", "complete"), ("r1", "delete", None, None), ("i1", "update", "w", "dropped"))
    assert out[2:] == [("delete", "r1", None, None, None), ("create", "i1", "i1", "dropped", "w")]


def test_item_without_shelf_is_silent():
    assert run(("i1", "create", "w", None), ("i1", "update", "w", None)) == []


def test_carrier_turns_into_an_episode():
    out = run(("r1", "create", "w", None), ("i1", "create", "w", "complete"), ("r1", "update", "tv_episode:x", None), ("r1", "update", "tv_episode:x", None), ("r1", "update", "w", None))
    assert out[2:] == [("delete", "r1", None, None, None), ("create", "i1", "i1", "complete", "w"), ("update", "i1", "r1", "complete", "w")]


def test_carrier_moves_into_an_occupied_work():
    out = run(("r1", "create", "a", None), ("r2", "create", "b", None), ("r1", "update", "b", None))
    assert out[2:] == [("delete", "r1", None, None, None), ("update", "r2", "r2", None, "b")]


def test_carrier_takes_its_note_to_a_free_work():
    out = run(("r1", "create", "a", None), ("i1", "create", "a", "complete"), ("r1", "update", "b", None))
    assert out[2:] == [("update", "r1", "r1", None, "b"), ("create", "i1", "i1", "complete", "a")]


def test_unknown_and_repeated_deletes():
    assert run(("r1", "delete", None, None), ("r2", "create", "w", None), ("r2", "delete", None, None), ("r2", "delete", None, None)) == [
        ("delete", "r1", None, None, None), ("create", "r2", "r2", None, "w"), ("delete", "r2", None, None, None), ("delete", "r2", None, None, None),
    ]


def test_revival_creates_again():
    out = run(("r1", "create", "w", None), ("r1", "delete", None, None), ("r1", "create", "w", None))
    assert [x[0] for x in out] == ["create", "delete", "create"]


def test_silent_loss_is_counted():
    author = Author()
    author.event(0, "i1", False, "create", "w", "complete")
    author.event(1, "i1", False, "update", "w", None)
    assert author.stranded == 1 and len(author.out) == 1


def test_unrelated_works_can_be_folded_apart():
    """Groups without a common record or work give the same activities as the whole author."""
    rng = random.Random(4)
    events, of = [], {}
    for seq in range(300):
        half = rng.choice("xy")
        uri = f"{rng.choice('ri')}{half}{rng.randint(0, 5)}"
        operation = rng.choice(["create", "update", "update", "delete"])
        work = rng.choice([f"{half}1", f"{half}2", f"tv_episode:{half}", None])
        events.append(("d", seq, uri, uri[0] == "r", operation, work if operation != "delete" else None, rng.choice(["complete", None])))
        of[seq] = half
    def fold(rows):
        step = pairing()
        return {x for r in rows for x in step(*r)}

    assert fold(events) == fold([e for e in events if of[e[1]] == "x"]) | fold([e for e in events if of[e[1]] == "y"])
