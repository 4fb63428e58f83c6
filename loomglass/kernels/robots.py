"""robots.txt: reading rules and deciding on paths."""

from dataclasses import dataclass, field

AGENT = "loomglass"


@dataclass
class Robots:
    allow: list[str] = field(default_factory=list)
    disallow: list[str] = field(default_factory=list)
    crawl_delay: float = 0.0
    sitemaps: list[str] = field(default_factory=list)


def parse_robots(content: str, agent: str = AGENT) -> Robots:
    """Rules of the group that names the agent best (the longest token that the agent's name contains), else of the first for all."""
    out = Robots()
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    agents_open = False
    for line in content.split("\n"):
        name, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not agents_open:
                groups.append(([], []))
            groups[-1][0].append(value)
            agents_open = True
            continue
        agents_open = False
        if name == "sitemap" and value:
            out.sitemaps.append(value)
        elif name in ("allow", "disallow", "crawl-delay"):
            if not groups:
                groups.append(([], []))
            groups[-1][1].append((name, value))
    ranked = [(len(t), -k) for k, (agents, _) in enumerate(groups) for t in agents if t and t.lower() in agent.lower()]
    chosen = -max(ranked)[1] if ranked else next((k for k, (agents, _) in enumerate(groups) if "*" in agents), None)
    for name, value in groups[chosen][1] if chosen is not None else ():
        if name == "crawl-delay":
            try:
                out.crawl_delay = float(value)
            except ValueError:
                out.crawl_delay = 0.0
        elif value:
            getattr(out, name).append(value)
    return out


def match_length(pattern: str, path: str) -> int:
    """Characters of the path that a rule's pattern covers, -1 if it doesn't match. "*" is any run, a last "$" the end."""
    to_end = pattern.endswith("$")
    pieces = pattern.removesuffix("$").split("*")
    if not path.startswith(pieces[0]):
        return -1
    at = len(pieces[0])
    for piece in pieces[1:]:
        if piece:
            found = path.find(piece, at)
            if found < 0:
                return -1
            at = found + len(piece)
    return -1 if to_end and at != len(path) else at


def allowed(r: Robots, path: str) -> bool:
    """The longest match decides; a disallow wins a tie; without a match a path is allowed."""
    deny = max((match_length(p, path) for p in r.disallow), default=-1)
    allow = max((match_length(p, path) for p in r.allow), default=-1)
    return allow > deny or deny < 0
