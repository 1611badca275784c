from lodestone.llm import sentencepiece, shared


def test_tasks_give_memory_back(monkeypatch):
    """At the end of a task, and of one that is stopped."""
    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    assert list(shared.released(iter)([1, 2])) == [1, 2] and len(calls) == 1
    stopped = shared.released(lambda x: (y for y in x))([1, 2])
    assert next(stopped) == 1
    stopped.close()
    assert len(calls) == 2


def test_release_runs():
    shared.release()


def test_remembered_chunks_are_few():
    """Some 240 bytes each, twice in an executor of two cores."""
    assert sentencepiece.REMEMBERED * 240 <= 50_000_000
