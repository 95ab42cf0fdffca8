from tidewater.llm import shared


def test_what_an_operator_keeps_goes_when_the_worker_runs_another():
    gone = []
    shared.give_back("a", lambda: gone.append("a"))
    shared.give_back("a", lambda: gone.append("a"))
    assert gone == []
    shared.give_back("b", lambda: gone.append("b"))
    assert gone == ["a"]
    shared.give_back()
    shared.give_back()
    assert gone == ["a", "b"] and not shared.KEPT
