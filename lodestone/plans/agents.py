"""Driver-side control flow: plans with dependencies, reflection rounds. Data stays in tables; the driver sees verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()


@dataclass
class Plan:
    steps: list[Step] = field(default_factory=list)

    def order(self) -> list[Step]:
        """Steps such that each comes after what it needs; raises on unknown names and cycles."""
        by, out, done = {s.name: s for s in self.steps}, [], set()
        left = list(self.steps)
        while left:
            ready = [s for s in left if all(n in done for n in s.needs)]
            if not ready:
                raise ValueError(f"unmet: {[(s.name, [n for n in s.needs if n not in by]) for s in left]}")
            for s in ready:
                out.append(s)
                done.add(s.name)
            left = [s for s in left if s.name not in done]
        return out

    def execute(self) -> dict:
        """Results by name. A step whose need failed is skipped, and so is what needs it; errors are kept as results."""
        results: dict[str, object] = {}
        for step in self.order():
            if any(isinstance(results.get(n), Exception) for n in step.needs):
                results[step.name] = RuntimeError("skipped: a step it needs failed")
                continue
            try:
                results[step.name] = step.run({n: results[n] for n in step.needs})
            except Exception as e:
                results[step.name] = e
        return results


def reflect(draft: str, critics: dict[str, Callable[[str], float]], revise: Callable[[str, dict[str, float]], str], threshold: float = 0.7, rounds: int = 3) -> tuple[str, dict[str, float], int]:
    """Revise until the mean of all critics reaches the threshold, `rounds` times at most; the best draft wins."""
    best, best_scores = draft, {k: f(draft) for k, f in critics.items()}
    used = 0
    current = draft
    mean = lambda s: sum(s.values()) / max(len(s), 1)
    scores = best_scores
    while mean(scores) < threshold and used < rounds:
        current = revise(current, scores)
        used += 1
        scores = {k: f(current) for k, f in critics.items()}
        if mean(scores) > mean(best_scores):
            best, best_scores = current, scores
    return best, best_scores, used


def should_plan(query: str) -> bool:
    """Long queries and those that join several questions."""
    q = query.lower()
    return len(q.split()) > 15 or q.count("?") > 1 or any(f" {w} " in q for w in ("compare", "then", "versus"))


def orchestrate(query: str, route: Callable[[str], str], retrieve: Callable[[str, str], list], assess: Callable[[str, list], str], refine: Callable[[str], str], generate: Callable[[str, list], str], evaluate: Callable[[str, str], float], rounds: int = 3) -> dict:
    """Route, retrieve, assess, generate, evaluate; a refined query is the one retrieved next. Each retrieval is a round."""
    history, asked, strategy = ["route"], query, route(query)
    if strategy == "none":
        return {"answer": generate(query, []), "history": [*history, "generate"], "rounds": 0, "score": None}
    answer, score, i = "", 0.0, 0
    for i in range(1, rounds + 1):
        hits = retrieve(asked, strategy)
        history += ["retrieve", "assess"]
        if assess(asked, hits) == "refine_query" and i < rounds:
            asked = refine(asked)
            history.append("refine")
            continue
        answer = generate(query, hits)
        score = evaluate(query, answer)
        history += ["generate", "evaluate"]
        if score >= 0.7:
            break
    return {"answer": answer, "history": [*history, "complete"], "rounds": i, "score": score}


# The mean score that an answer must reach.
PASS = 0.7


@dataclass
class Verdict:
    scores: dict[str, float]
    feedback: list[str]

    @property
    def mean(self) -> float:
        return sum(self.scores.values()) / max(len(self.scores), 1)

    @property
    def passed(self) -> bool:
        return self.mean >= PASS


def criticise(answer: str, critics: dict[str, Callable[[str], float]], advice: dict[str, str] | None = None) -> Verdict:
    """Scores of an answer, clamped to 0..1 (a critic that fails gives .5), and advice where one is below .5."""
    scores = {}
    for name, f in critics.items():
        try:
            scores[name] = min(1.0, max(0.0, float(f(answer))))
        except Exception:
            scores[name] = 0.5
    return Verdict(scores, [(advice or {}).get(n, f"Improve {n}.") for n, s in scores.items() if s < 0.5])


def react(question: str, think: Callable[[str, list[dict]], dict], tools: dict[str, Callable[..., object]], rounds: int = 5) -> dict:
    """Thought, action, observation in turn: think(question, trace) gives {"thought", "action", "input"} or {"thought", "answer"}.

    Unknown tools and tools that fail become observations; without an answer after `rounds` the answer is None.
    """
    trace: list[dict] = []
    for _ in range(rounds):
        step = dict(think(question, trace))
        if "answer" in step:
            return {"answer": step["answer"], "trace": [*trace, step]}
        tool = tools.get(step.get("action", ""))
        try:
            step["observation"] = tool(**step.get("input", {})) if tool else f"no tool named {step.get('action')}; there are {sorted(tools)}"
        except Exception as e:
            step["observation"] = f"{type(e).__name__}: {e}"
        trace.append(step)
    return {"answer": None, "trace": trace}
