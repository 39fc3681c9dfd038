"""Experiment parameters: defaults, star designs, solver products, footprints."""

from __future__ import annotations

import copy
import itertools

# The default experiment.
DEFAULTS = {
    "tag": "default",
    "data": {"graph_type": "path", "weight_scale": 0.5, "random_weight": 0, "both_directions": 0, "n": 10},
    "solver": {
        "Rob": {"mode": [0, 5], "iterations": 100, "beta": 32},
        "SatGreedy": {"epsilon": 0.2, "gamma": 0.1, "satgreedy": 0, "singlegreedy": 0, "singlegreedycelf": 1, "allgreedy": 0, "dimbeta": 32},
        "Imm": {"epsilon": 0.2},
    },
    "strategy": {"Degree": {}, "NetShield": {}, "Random": {"random_id": 1}, "Pagerank": {}, "Katz": {}, "Aquaintance": {}, "Betweenness": {}},
    "problem": {"number_of_blocked_nodes": -1, "seeds": 2, "lt_model": 0, "alpha": 1},
    "full_rerun": 1,
    "graph_analysis": 1,
    "solver_execution_timeout": 86400,
}
REQUIRED = ("tag", "data", "solver", "strategy", "problem")
#: Sections whose entries are named by the experiment alone.
NAMED = ("solver", "strategy")


def filled(given: dict, defaults: dict) -> dict:
    """``given`` with missing keys from the defaults; a named section that is given gains no entries, only their missing keys."""

    def merge(own: dict, base: dict, named: bool) -> dict:
        out = copy.deepcopy(own)
        for key, value in base.items():
            if key not in own:
                if not named:
                    out[key] = copy.deepcopy(value)
            elif isinstance(value, dict) and isinstance(own[key], dict):
                out[key] = merge(own[key], value, False)
        return out

    out = merge({k: v for k, v in given.items() if k not in NAMED}, {k: v for k, v in defaults.items() if k not in NAMED}, False)
    for section in NAMED:
        if section in given:
            out[section] = merge(given[section], defaults.get(section, {}), True)
        elif section in defaults:
            out[section] = copy.deepcopy(defaults[section])
    return out


def first_values(tree: dict) -> dict:
    """Every list replaced by its first element (an empty one by None)."""
    pick = lambda v: first_values(v) if isinstance(v, dict) else ((v[0] if v else None) if isinstance(v, list) else v)
    return {k: pick(v) for k, v in tree.items()}


def flat(tree: dict, prefix: str = "") -> dict:
    """Nested keys joined by '_'."""
    out = {}
    for k, v in tree.items():
        name = f"{prefix}_{k}" if prefix else k
        out |= flat(v, name) if isinstance(v, dict) else {name: v}
    return out


def star(tree: dict) -> list[dict]:
    """One set per alternative of ``[default, [alternatives]]`` entries, one key varied at a time in sorted order; the default last."""
    base = first_values(tree)
    sets = []

    def vary(part: dict, place: tuple[str, ...]) -> None:
        for key in sorted(part):
            value = part[key]
            if isinstance(value, dict):
                vary(value, (*place, key))
            elif isinstance(value, list) and len(value) == 2 and isinstance(value[1], list):
                for other in value[1]:
                    new = copy.deepcopy(base)
                    spot = new
                    for p in place:
                        spot = spot[p]
                    spot[key] = other
                    sets.append(new)

    vary(tree, ())
    return [*sets, base]


def initials(name: str) -> str:
    return "".join(word[0] for word in name.split("_") if word)


def tokens(tree: dict) -> list[str]:
    """Initials and value of every leaf; floats with four decimals."""
    out = []
    for k, v in tree.items():
        if isinstance(v, dict):
            out += tokens(v)
        else:
            out.append(initials(k) + (f"{v:.4f}" if isinstance(v, float) else str(v)))
    return out


def footprint(tree: dict) -> str:
    return "_".join(sorted(tokens(tree))).replace(".", "")


class Parameters:
    """A validated experiment."""

    def __init__(self, given: dict, load_defaults: bool = True):
        self.params = filled(given, DEFAULTS) if load_defaults else copy.deepcopy(given)
        missing = [k for k in REQUIRED if k not in self.params]
        assert not missing, f"missing sections: {missing}"

    def data_sets(self) -> list[dict]:
        return star(self.params["data"])

    def problem_sets(self) -> list[dict]:
        return star(self.params["problem"])

    def solver_sets(self) -> list[dict]:
        """Every problem set with every combination of every solver's listed values; a problem's key wins over a solver's."""
        if not self.params["solver"]:
            raise ValueError("no solver is given")
        out = []
        for problem in self.problem_sets():
            for name, own in self.params["solver"].items():
                lists = [v if isinstance(v, list) else [v] for v in own.values()]
                out += [{"solver": name} | dict(zip(own, values)) | problem for values in itertools.product(*lists)]
        return out

    def immunization_sets(self) -> list[dict]:
        timeout = self.params.get("solver_execution_timeout")
        return [dict(v) | {"solver_name": k, "solver_timeout": timeout} for k, v in self.params["strategy"].items()]

    def defaults(self) -> dict:
        return first_values(self.params)

    def flat_defaults(self) -> dict:
        return flat(self.defaults())
