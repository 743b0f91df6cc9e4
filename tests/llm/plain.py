"""Plain versions of the operators, one row at a time, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def random_parts(word, model, threshold=0.4, scale=1_000_000, least=20):
    """Spans of the random parts of a word, by a plain loop over its transitions."""
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    codes = [alphabet.index(c) for c in word]
    ratios = [model[a * len(alphabet) + b] for a, b in zip(codes, codes[1:])]
    mean = lambda start, end: sum(ratios[start : end - 1]) / (end - 1 - start) / scale
    if mean(0, len(word)) >= threshold:
        return [(0, len(word))]
    limit, found, total, start, best, end = round(threshold * scale), [], 0, 0, 0, 0
    for i, ratio in enumerate(ratios, 1):
        total += ratio - limit
        if total < 0:
            if best > 0:
                found.append((start, end))
            total, start, best, end = 0, i, 0, i
        elif total > best:
            best, end = total, i + 1
    if best > 0:
        found.append((start, end))
    out = []
    for own in found:
        part = word[slice(*own)]
        start, end = own[0] + len(part) - len(part.lstrip("/_=-")), own[1] - len(part) + len(part.rstrip("/_=-"))
        core = word[start:end]
        outer = start - len(re.search("[^/_=-]*$", word[:start])[0]), end + len(re.match("[^/_=-]*", word[end:])[0])
        head, tail = re.match("[^/_=-]*[/_=-]+", core), re.search("[/_=-]+[^/_=-]*$", core)
        inner = start + (len(head[0]) if head else 0), end - (len(tail[0]) if tail else 0)
        tried = [*((a[0], b[1]) for a in (outer, inner) for b in (outer, inner)), own]
        fit = [t for t in tried if t[1] - t[0] >= least and mean(*t) >= threshold]
        if fit and fit[0] not in out:
            out.append(fit[0])
    return out


def all_spans(text, model, window=256):
    """Base spans and those of the model in what they leave, by start and kind."""
    base = base_spans(text)
    letters = list(text or "")
    for start, _, end in base:
        letters[start:end] = " " * (end - start)
    found = list(base)
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", "".join(letters)):
        at = run.start()
        while at < run.end():
            end = run.end() if run.end() - at < window + 20 else at + window
            found += [(at + s, 3, at + e) for s, e in random_parts("".join(letters[at:end]), model)]
            at = end
    return sorted(found)


def span_text(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{s}:{e}" for s, k, e in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def near_duplicates(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] of [(doc_id, text)], in the order of the rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return [(d, len(s), best.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


def floor_vector(v, scale=64):
    import math

    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(x)) for x in v]


def top_k(rows, queries, k=20):
    """{(query_id, rank, vec_id, score)} of [(vec_id, vector)]."""
    known = [(i, floor_vector(v)) for i, v in rows if i is not None and floor_vector(v) is not None]
    out = set()
    for q, v in queries:
        if q is None or floor_vector(v) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(floor_vector(v), x)), i) for i, x in known if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def schedule(shares):
    """[(source, turn)] for each slot of one cycle: earliest deadline first among released blocks, by Pfair windows."""
    cycle, had, out = sum(shares.values()), Counter(), []
    for t in range(cycle):
        ready = []
        for source, c in shares.items():
            k = had[source]
            if k < c and k * cycle // c <= t:
                ready.append((-(-(k + 1) * cycle // c), source))
        source = min(ready)[1]
        out.append((source, had[source]))
        had[source] += 1
    return out


def leaf_digest(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha256("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def merkle(rows):
    """Sorted result rows of the manifest of [(doc_id, source, lang, n_chars, text)]."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf_digest(r))
    groups = {s: sorted((r for r in rows if r[1] == s), key=order) for s in sources}
    trees = {s: tree_levels([leaf_digest(r) for r in groups[s]]) for s in sources}
    top = tree_levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(groups[s]):
            doc_id, text = row[0], row[4]
            leaf = now = leaf_digest(row)
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                now = leaf_digest((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), text)))
            folded, proof = now, ""
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = at - at % 16
                    left, right = "".join(level[run:at]), "".join(level[at + 1 : run + 16])
                    proof, folded, at = proof + left + right, sha256(left + folded + right), at // 16
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, sha256(proof), folded, folded == root))
    return sorted(out, key=str)


def token_groups(text, a_tokenizer, a_bytes, b_model, b_bytes):
    """[([a ids], [b ids])] of one text."""
    if not text:
        return []
    whole = " " + text
    a, b = a_tokenizer.encode(whole, add_special_tokens=False).ids, b_model.encode(text)
    if b"".join(a_bytes[i] for i in a) != whole.encode() or b"".join(b_bytes[i] for i in b) != whole.encode():
        return []
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            groups[-1][0].append(a[i])
            at_a += len(a_bytes[a[i]])
            i += 1
        else:
            groups[-1][1].append(b[j])
            at_b += len(b_bytes[b[j]])
            j += 1
        if at_a == at_b and (i < len(a) or j < len(b)):
            groups.append(([], []))
    return groups


def alignment(rows, *vocabularies):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] of [(doc_id, text)]."""
    every = [token_groups(text, *vocabularies) for _, text in rows]
    links = [Counter((a, b) for left, right in groups for a in left for b in right) for groups in every]
    held = Counter(pair for own in links for pair in own)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc_id, _), groups, own in zip(rows, every, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(t for p, t in own.items() if held[p] == most[p[0]])
        total = sum(t * held[p] for p, t in own.items())
        sizes = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values())
        out.append((doc_id, *sizes, best, total, sha256(text) if groups else ""))
    return out
