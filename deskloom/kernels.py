"""Helpers that run inside Spark tasks on Arrow batches.

Each one is a small block function: Spark partitions the rows, the helper works
on one batch (or one run of batches) and keeps bounded state.
"""

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from deskloom import fixed

# Largest score matrix (queries x documents) held at once: 4M doubles = 32 MB.
TILE_CELLS = 4_000_000
# Largest number of posting products expanded at once.
TILE_PRODUCTS = 4_000_000
# Domains a document is scored against at once.
DOMAIN_TILE = 512
# List values that are worked on at once; the arrays of a step take some 200 bytes a value.
PART_VALUES = 250_000
# Rows that wait before they are ranked with the rows held.
WAITING_ROWS = 500_000


def nfkc(text):
    # Arrow's own utf8_normalize leaves letters decomposed, so not that one.
    done = (x if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist())
    return pa.array(done, pa.string())


class Literals:
    """Which of some rules a text's literals allow, found in one pass over the text.

    A rule is a list of groups, each a list of literals. It is possible in a text
    that holds at least one literal of each group. The pass looks for one group of
    each rule, that of the longest literals, as they are the rarest; the other
    groups of a rule are looked for once that one is found.
    """

    def __init__(self, rules):
        self.others = []
        self.allowed = {}  # numbers of rules by literal
        for number, groups in enumerate(rules):
            key = max(groups, key=lambda group: min(map(len, group)))
            self.others.append([group for group in groups if group is not key])
            for literal in key:
                self.allowed.setdefault(literal, set()).add(number)
        try:
            import ahocorasick
        except ImportError:  # without the automaton each literal is looked for
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for literal in self.allowed:
            self.automaton.add_word(literal, literal)
        self.automaton.make_automaton()

    def held(self, text):
        """The literals of the first groups that a text holds."""
        if self.automaton is None:
            return {literal for literal in self.allowed if literal in text}
        return {literal for _, literal in self.automaton.iter(text)}

    def possible(self, text):
        """Numbers of the rules that are possible in a text, in order."""
        found = set().union(*[self.allowed[literal] for literal in self.held(text)])
        return sorted(n for n in found if all(any(word in text for word in group) for group in self.others[n]))


def sentence_ends(text):
    """Where each of the marks that may end a chunk stands, per mark in rising order."""
    return [[found.start() for found in re.finditer(f"(?={re.escape(mark)})", text)] for mark in fixed.CHUNK_MARKS]


def cut_before(ends, low, high):
    """The place to cut between low and high: behind a mark that fits in, high if none does.

    Marks come by rank. A later one counts only if it starts behind the cut.
    """
    cut = None
    for mark, places in zip(fixed.CHUNK_MARKS, ends, strict=True):
        last = bisect_right(places, high - len(mark)) - 1
        if last >= 0 and places[last] >= (low if cut is None else cut + 1):
            cut = places[last] + len(mark)
    return high if cut is None else cut


def chunk_spans(text, size, overlap):
    """Start and end of every chunk of one text, cut behind sentences where it can be.

    A cut is looked for in the last fifth of a chunk. Chunks overlap, unless that
    would not get on.
    """
    whole = len(text)
    ends = sentence_ends(text) if whole > size else ()
    start = 0
    while start < whole:
        high = start + size
        end = whole if high >= whole else max(start + 1, cut_before(ends, max(start + 1, high - size // 5), high))
        yield start, end
        start = max(end - overlap, start) if end - overlap > start else end


def chunks(texts, size, overlap, drop_tail):
    """Chunks of every text with their places, blank ones left out; none of null."""
    offsets, starts, ends, parts = [0], [], [], []
    for text in texts.to_pylist():
        spans = list(chunk_spans(text, size, overlap)) if text else []
        if drop_tail and len(spans) > 1 and spans[-2][1] == len(text):
            spans.pop()
        for a, b in spans:
            part = text[a:b].strip()
            if part:
                starts.append(a)
                ends.append(b)
                parts.append(part)
        offsets.append(len(parts))
    rows = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())],
        ["start", "end", "chunk"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def flat_lists(lists):
    """All values of a list column, the row of each, and the number of rows; null counts as empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(width)), width), len(width)


def list_parts(lists, values=None):
    """Runs of rows (first, last) whose lists hold so many values together, or one longer list."""
    values = values or PART_VALUES
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(width, dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + values, "right")))
        yield first, last
        first = last


def parts(batches, lists, values=None):
    """Batches cut so that the lists of one column hold a bounded number of values.

    A batch has many rows, and what a helper makes of its lists is many times
    their size. Cut, a task holds a part's share of that, however long the texts.
    """
    for batch in batches:
        for first, last in list_parts(batch.column(lists), values):
            yield batch.slice(first, last - first)


def looked_up(batches, lists, known):
    """Parts of batches, each with the places of its terms among the known ones, null for others.

    A look-up makes a table of all known terms, so it is for as many values as there
    are known terms; what it gives is small, and all else is made of a part.
    """
    for batch in parts(batches, lists, max(PART_VALUES, len(known))):
        at = pc.index_in(batch.column(lists).flatten().field("term"), value_set=known)
        done = 0
        for part in parts([batch], lists):
            size = len(part.column(lists).flatten())
            yield part, at.slice(done, size)
            done += size


def mapped_lists(batches, lists, name, made, values=None):
    """Batches with one list column replaced by what made gives for it, a part at a time."""
    for part in parts(batches, lists, values):
        columns = [name if column == lists else column for column in part.schema.names]
        found = [made(part.column(c)) if c == lists else part.column(c) for c in part.schema.names]
        yield pa.RecordBatch.from_arrays(found, columns)


def list_array(row, n, **columns):
    """A list column of structs from flat columns sorted by row."""
    offsets = np.searchsorted(row, np.arange(n + 1))
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def tally(lists):
    """Distinct terms of every list with how often they occur, by first letter order of the batch."""
    terms, row, n = flat_lists(lists)
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(1, len(coded.dictionary))
    pairs, count = np.unique(row * wide + codes, return_counts=True)
    found = coded.dictionary.take(pa.array(pairs % wide)).cast(pa.string())
    return list_array(pairs // wide, n, term=found, tf=pa.array(count.astype(np.int32)))


def word_terms(lists, stop_words, pairs=True):
    """Distinct words and neighbouring pairs of every list of words, with how often they occur.

    Stop words are dropped first, so a pair may span some. Pairs are counted as
    pairs of numbers; only distinct ones become text.
    """
    words, row, n = flat_lists(lists)
    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.string())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = ~pc.is_in(known, value_set=stop_words).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    codes, row = codes[kept], row[kept]
    wide = max(1, len(known))
    keys, count = np.unique(row * wide + codes, return_counts=True)
    rows, terms = [keys // wide], [known.take(pa.array(keys % wide))]
    counts = [count]
    if pairs and len(codes) > 1:
        near = np.flatnonzero(row[1:] == row[:-1])
        different, number = np.unique(codes[near] * wide + codes[near + 1], return_inverse=True)
        keys, count = np.unique(row[near] * max(1, len(different)) + number, return_counts=True)
        first, second = (known.take(pa.array(part)) for part in (different // wide, different % wide))
        text = pc.binary_join_element_wise(first, second, " ")
        rows.append(keys // max(1, len(different)))
        terms.append(text.take(pa.array(keys % max(1, len(different)))))
        counts.append(count)
    row, term, count = np.concatenate(rows), pa.concat_arrays(terms), np.concatenate(counts)
    order = np.argsort(row, kind="stable")
    return list_array(row[order], n, term=term.take(pa.array(order)), tf=pa.array(count[order].astype(np.int32)))


def heavy_terms(batches, capacity):
    """Summary of the term lists of a task: (term, total, df) of at most `capacity` terms.

    Terms are counted exactly until more than twice the capacity are held; then
    the rarest go. A last row without term has in `total` what any term can lack
    at most: the sum, over the cuts, of the largest total that went. So summaries
    merge by adding up, and what is passed on doesn't grow with the task.
    """
    held, lacking = None, 0
    names = ["term", "total", "df"]
    for batch in parts(batches, "terms"):
        values, _, _ = flat_lists(batch.column("terms"))
        tf = values.field("tf").cast(pa.int64())
        more = pa.table([values.field("term"), tf, pa.array(np.ones(len(tf), np.int64))], names)
        both = more if held is None else pa.concat_tables([held, more])
        held = both.group_by("term").aggregate([("total", "sum"), ("df", "sum")]).rename_columns(names)
        if held.num_rows > 2 * capacity:
            held, least = _largest(held, capacity)
            lacking += least
    if held is not None and held.num_rows > capacity:
        held, least = _largest(held, capacity)
        lacking += least
    if held is not None:
        yield from held.combine_chunks().to_batches()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([lacking]), pa.array([0])], names)


def _largest(table, n):
    """The n rows of the largest totals, and the largest total of the others."""
    total = table.column("total").to_numpy()
    order = np.argpartition(-total, n)
    return table.take(pa.array(np.sort(order[:n]))), int(total[order[n:]].max())


def word_grams(lists, size):
    """Distinct character sequences of every list of words, with how often they occur.

    A word has an underscore at each end and then gives all its sequences of the
    size, at least one. Each different word of a batch is cut once.
    """
    words, row, n = flat_lists(lists)
    coded = words.dictionary_encode()
    known = [f"_{word}_" for word in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut = [[word[i : i + size] for i in range(max(1, len(word) - size + 1))] for word in known]
    numbers = {}
    flat = np.array([numbers.setdefault(gram, len(numbers)) for own in cut for gram in own], np.int64)
    sizes = np.array([len(own) for own in cut], np.int64)
    first = np.cumsum(sizes) - sizes
    keys, count = np.unique(row * max(1, len(known)) + codes, return_counts=True)
    row, word = keys // max(1, len(known)), keys % max(1, len(known))
    fan = sizes[word]
    at = np.repeat(first[word], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    wide = max(1, len(numbers))
    keys, place = np.unique(np.repeat(row, fan) * wide + flat[at], return_inverse=True)
    tf = np.bincount(place, np.repeat(count, fan), len(keys)).astype(np.int32)
    grams = pa.array(list(numbers), pa.string()).take(pa.array(keys % wide))
    return list_array(keys // wide, n, gram=grams, tf=pa.array(tf))


def likeliest(lists, known, weights, names):
    """The name whose weights, times the counts, sum up highest for every list of
    (gram, tf); the first of equals, null for an empty list.

    weights: whole numbers (gram, name). Grams that no name has aren't looked at.
    """
    values, row, n = flat_lists(lists)
    at = pc.index_in(values.field("gram"), value_set=known)
    inside = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    place = at.drop_null().to_numpy(zero_copy_only=False)
    row, tf = row[inside], values.field("tf").to_numpy(zero_copy_only=False)[inside].astype(np.int64)
    best, top = np.full(n, -1), np.full(n, np.iinfo(np.int64).min)
    edge = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    for number in range(len(names)):
        score = np.zeros(n, np.int64)
        if len(row):
            score[row[edge]] = np.add.reduceat(weights[place, number] * tf, edge)
        better = (score > top) & (np.bincount(row, minlength=n) > 0)
        best[better], top[better] = number, score[better]
    return pa.array([names[at] if at >= 0 else None for at in best.tolist()], pa.string())


def weigh(lists, vocabulary):
    """Unit tf-idf vectors from lists of (term, tf): (slot, tf, weight) by slot.

    vocabulary: the known terms, their slots and their inverse document frequencies.
    """
    known, slots, idf = vocabulary
    counted, row, n = flat_lists(lists)
    at = pc.index_in(counted.field("term"), value_set=known)
    inside = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    place = at.drop_null().to_numpy(zero_copy_only=False)
    row, tf = row[inside], counted.field("tf").to_numpy(zero_copy_only=False)[inside]
    slot = slots[place]
    order = np.lexsort((slot, row))
    row, tf, slot, raw = row[order], tf[order], slot[order], (tf * idf[place])[order]
    length = np.sqrt(np.bincount(row, raw * raw, n))
    weight = raw / length[row] if len(row) else raw
    return list_array(row, n, slot=pa.array(slot, pa.int64()), tf=pa.array(tf, pa.int32()), weight=pa.array(weight))


def sparse_dot(first, second):
    """Dot product of two list columns of (slot, weight), row by row."""
    runs = [(first, last - first) for first, last in list_parts(second)]
    return pa.concat_arrays([pa.array([], pa.float64()), *[_dot(first.slice(*run), second.slice(*run)) for run in runs]])


def _dot(first, second):
    sides = []
    for lists in (first, second):
        values, row, n = flat_lists(lists)
        sides.append((row, values.field("slot").to_numpy(zero_copy_only=False), values.field("weight").to_numpy(zero_copy_only=False)))
    slots, code = np.unique(np.concatenate([slot for _, slot, _ in sides]), return_inverse=True)
    split = len(sides[0][0])
    keys = [row * max(1, len(slots)) + own for (row, *_), own in zip(sides, (code[:split], code[split:]), strict=True)]
    _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    # Without a common slot the sums would be whole numbers.
    return pa.array(np.bincount(sides[0][0][i], sides[0][2][i] * sides[1][2][j], n).astype(float))


def best_rows(query, doc, score, n):
    """Indices of the n best rows of every query: score down, document up."""
    order = np.lexsort((doc, -score, query))
    q = query[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, int)
    run = np.diff(np.r_[first, len(q)])
    place = np.arange(len(q)) - np.repeat(first, run)
    return order[place < n]


class Best:
    """Running n best (query, document, score, fits) rows of one task.

    Rows are gathered and ranked in bulk. From then on a query's n-th score is
    the least that a row needs, so most rows never get in.
    """

    def __init__(self, n, queries):
        self.n = n
        self.least = np.full(queries, -np.inf)
        self.parts = []
        self.waiting = 0
        self.held = 0

    def add(self, *rows):
        if len(rows[0]):
            self.parts.append(rows)
            self.waiting += len(rows[0])
        if self.waiting > max(WAITING_ROWS, self.held):
            self.rank()

    def rank(self):
        rows = [np.concatenate(columns) for columns in zip(*self.parts, strict=True)]
        keep = best_rows(*rows[:3], self.n)
        rows = [column[keep] for column in rows]
        query, score = rows[0], rows[2]
        count = np.bincount(query, minlength=len(self.least))
        full = np.flatnonzero(count >= self.n)
        self.least[full] = score[np.cumsum(count)[full] - 1]
        self.parts, self.waiting, self.held = [rows], 0, len(query)

    def batches(self, query_ids, doc_type, rows=50_000):
        if not self.parts:
            return
        self.rank()
        query, doc, score, fits = self.parts[0]
        for at in range(0, len(query), rows):
            part = slice(at, at + rows)
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(query[part])),
                    pa.array(doc[part]).cast(doc_type),
                    pa.array(score[part], pa.float64()),
                    pa.array(fits[part], pa.bool_()),
                ],
                ["query_id", "doc_id", "score", "fits"],
            )


def as_numpy(array):
    values = array.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def matrix(array, dim):
    """Rows of a list column as a matrix; a wrong length becomes a zero row."""
    out = np.zeros((len(array), dim))
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    good = lengths == dim
    if good.any():
        flat = array.filter(pa.array(good)).flatten()
        out[good] = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def domain_codes(names, domains):
    """Place of every domain in the sorted names, one beyond the last if absent."""
    if len(names) == 0:
        return np.zeros(len(domains), int)
    at = np.minimum(np.searchsorted(names, domains), len(names) - 1)
    return np.where(names[at] == domains, at, len(names))


def allowed(query_code, doc_code):
    """Mask of (query, document) pairs whose domains agree; -1 takes any."""
    return (query_code[:, None] < 0) | (query_code[:, None] == doc_code[None, :])


def top_of_tile(scores, fits, candidates, docs, best, queries):
    """The candidate cells of a score tile that may be among the best of their query."""
    least = best.least[queries]
    good = candidates & (scores >= least[:, None])
    crowded = np.flatnonzero(good.sum(axis=1) > best.n)
    if len(crowded):
        own = np.where(good[crowded], scores[crowded], -np.inf)
        edge = -np.partition(-own, best.n - 1, axis=1)[:, best.n - 1 : best.n]
        good[crowded] &= own >= edge
    rows, cols = np.nonzero(good)
    return queries[rows], docs[cols], scores[rows, cols], fits[rows, cols]


def dense_top(batches, block, n, prefilter):
    """n nearest documents per query among this task's documents (cosine).

    block: query ids, unit query matrix, sorted domain names, and the domain
    code of every query.
    """
    query_ids, vectors, names, domains = block
    best, doc_type = Best(n, len(vectors)), None
    for batch in batches:
        doc_type = batch.column("doc_id").type
        docs = as_numpy(batch.column("doc_id"))
        doc_domain = domain_codes(names, as_numpy(batch.column("domain").fill_null("")))
        unit = matrix(batch.column("embedding"), vectors.shape[1])
        step_q = max(1, min(len(vectors), 4096))
        step_d = max(1, TILE_CELLS // step_q)
        for d in range(0, len(docs), step_d):
            for q in range(0, len(vectors), step_q):
                scores = np.round(vectors[q : q + step_q] @ unit[d : d + step_d].T, 9)
                fits = allowed(domains[q : q + step_q], doc_domain[d : d + step_d])
                candidates = fits if prefilter else np.ones_like(fits)
                own = np.arange(q, q + len(scores))
                best.add(*top_of_tile(scores, fits, candidates, docs[d : d + step_d], best, own))
    if doc_type is not None:
        yield from best.batches(query_ids, doc_type)


def sparse_top(batches, block, n):
    """n best documents per query by sparse dot product, scores above zero only.

    Input rows are documents (doc_id, domain, postings) with postings (slot,
    weight) by slot. block: query ids, sorted domain names, domain code of every
    query, and the query postings by slot (known slots, their starts, query
    numbers, weights).

    Documents of a domain are scored with the queries that may find them only,
    unless the queries ask for many domains.
    """
    query_ids, names, domains, known, starts, post_query, post_weight = block
    best, doc_type, asked = Best(n, len(domains)), None, {}
    for batch in parts(batches, "postings"):
        doc_type = batch.column("doc_id").type
        docs = as_numpy(batch.column("doc_id"))
        doc_domain = domain_codes(names, as_numpy(batch.column("domain").fill_null("")))
        values, number, _ = flat_lists(batch.column("postings"))
        slots = values.field("slot").to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, slots), max(0, len(known) - 1))
        wanted = np.flatnonzero(known[at] == slots) if len(known) else np.zeros(0, int)
        held = at[wanted], number[wanted], values.field("weight").to_numpy(zero_copy_only=False)[wanted]
        split = len(names) <= SPLIT_DOMAINS
        for code in np.unique(doc_domain).tolist() if split else [None]:
            if code not in asked:
                asked[code] = queries_of(code, domains, starts, post_query, post_weight)
            group, own = np.arange(len(docs)), held
            if split:
                group = np.flatnonzero(doc_domain == code)
                kept = doc_domain[held[1]] == code
                own = held[0][kept], np.searchsorted(group, held[1][kept]), held[2][kept]
            _sparse_tiles(asked[code], own, docs[group], doc_domain[group], domains, best)
    if doc_type is not None:
        yield from best.batches(query_ids, doc_type)


# Domains that documents are told apart by in a search; the query postings are held once for each.
SPLIT_DOMAINS = 16


def queries_of(code, domains, starts, post_query, post_weight):
    """The queries that documents of a domain may be found by, all without a code:
    their numbers, and their postings (starts, place among them, weight)."""
    good = np.ones(len(domains), bool) if code is None else (domains < 0) | (domains == code)
    kept = good[post_query]
    place = (np.cumsum(good) - 1)[post_query[kept]] if len(post_query) else post_query
    return np.flatnonzero(good), np.r_[0, np.cumsum(kept)][starts], place, post_weight[kept]


def _sparse_tiles(asked, held, docs, doc_domain, domains, best):
    """Score documents, their postings (query slot, document, weight) by document, with queries."""
    queries, starts, post_query, post_weight = asked
    slots, number, weights = held
    step = max(1, TILE_CELLS // max(1, len(queries)))
    for d in range(0, len(docs), step):
        low, high = np.searchsorted(number, [d, d + step])
        if low == high or not len(queries):
            continue
        width = min(step, len(docs) - d)
        total = np.zeros(len(queries) * width)
        fan = starts[slots[low:high] + 1] - starts[slots[low:high]]
        edges = np.r_[0, np.cumsum(fan)]
        i = 0
        while i < high - low:
            upto = max(i + 1, np.searchsorted(edges, edges[i] + TILE_PRODUCTS, "right") - 1)
            count = fan[i:upto]
            source = np.repeat(np.arange(low + i, low + upto), count)
            within = np.arange(count.sum()) - np.repeat(edges[i:upto] - edges[i], count)
            posting = starts[slots[source]] + within
            cell = post_query[posting] * width + (number[source] - d)
            total += np.bincount(cell, weights[source] * post_weight[posting], len(total))
            i = upto
        scores = np.round(total.reshape(len(queries), width), 9)
        fits = allowed(domains[queries], doc_domain[d : d + width])
        best.add(*top_of_tile(scores, fits, fits & (scores > 0), docs[d : d + width], best, queries))


def best_domain(batches, base, head, tile=DOMAIN_TILE):
    """The number of the domain of the highest score for every document, the first of equals.

    Input rows are documents (doc_id, domain, words, tail): words are (term, tf),
    tail the summed gains per domain number of words that are not in the head.
    head: its terms and their gains per domain; base: per domain, the log of its
    smoothed size. Score: gains minus words times base.

    Domains are scored a tile at a time and a document keeps the best so far, so
    what is held is rows x tile, however many domains there are.
    """
    known, gains = head
    step = max(1, TILE_PRODUCTS // tile)  # words looked up at once
    for batch, at in looked_up(batches, "words", known):
        values, row, n = flat_lists(batch.column("words"))
        tf = values.field("tf").to_numpy(zero_copy_only=False).astype(float)
        inside = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        place = at.drop_null().to_numpy(zero_copy_only=False)
        length = np.bincount(row, tf, n)
        # Words in the order of the head: sums don't follow the order within a batch.
        order = np.lexsort((place, row[inside]))
        place, owner, tf = place[order], row[inside][order], tf[inside][order]
        more, tailed, _ = flat_lists(batch.column("tail"))
        domain = more.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
        gain = more.field("gain").to_numpy(zero_copy_only=False)
        order = np.argsort(domain, kind="stable")
        domain, tailed, gain = domain[order], tailed[order], gain[order]
        rows = max(1, TILE_CELLS // tile)
        found = np.full(n, -1)
        for first in range(0, n, rows):
            last = min(n, first + rows)
            low, high = np.searchsorted(owner, [first, last])
            top = np.full(last - first, -np.inf)
            for d in range(0, len(base), tile):
                part = base[d : d + tile]
                score = -length[first:last, None] * part
                for i in range(low, high, step):
                    upto = min(i + step, high)
                    shares = gains[place[i:upto], d : d + tile] * tf[i:upto, None]
                    edge = np.flatnonzero(np.diff(owner[i:upto], prepend=-1))
                    score[owner[i:upto][edge] - first] += np.add.reduceat(shares, edge, axis=0)
                a, b = np.searchsorted(domain, [d, d + tile])
                own = (tailed[a:b] >= first) & (tailed[a:b] < last)
                np.add.at(score, (tailed[a:b][own] - first, domain[a:b][own] - d), gain[a:b][own])
                score = np.round(score, 6)
                best = score.argmax(axis=1)
                reached = score[np.arange(last - first), best]
                better = reached > top
                found[first:last][better] = best[better] + d
                top[better] = reached[better]
        found[length == 0] = -1
        names = pa.array(found, pa.int64(), mask=found < 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), names], ["doc_id", "domain", "_best"])
