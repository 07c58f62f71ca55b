"""An inverted index of sparse unit vectors with block maxima, and its exact nearest neighbours."""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: Part of the points' squared weights that features which are not listed may hold.
LIGHT = 0.01
#: Blocks that a query opens before it knows what a neighbour must reach.
FIRST = 6
#: Postings of a feature up to which they are added together with other features'.
RARE = 1024
#: Postings that are gathered in one step.
SORTED = 1 << 18
#: More than what sums of 32-bit weights lose.
ROUNDING = 1e-5
#: What a neighbour at no distance has for its distance in votes.
NEAREST = 0.002


class BlockMaxIndex:
    """Points, each with counts of two classes, in blocks of BLOCK.

    Features that more than an eighth of the points have are common: a row of weights in every
    block, and the largest of each block. Of the others, those of least weight for their number
    of postings are light, up to the part LIGHT of all squared weights: they stand with their
    points. The rest are lists of postings. A query adds up the lists, bounds every block by its
    best sum, the maxima and what light features can add at most (the product of their lengths in
    query and point), and opens blocks from the best bound on until no bound reaches the worst
    neighbour it holds. Points whose bound reaches it are summed in full. The result equals a
    full scan's.
    """

    def __init__(self, points: list[tuple[np.ndarray, np.ndarray]], positive, negative, names) -> None:
        sizes = np.array([len(ids) for ids, _ in points])
        often = _often(points)
        order = sorted(range(len(points)), key=lambda i: (_kind(*points[i], often), int(sizes[i]), i))
        self.positive = np.array([positive[i] for i in order], float)
        self.total = self.positive + np.array([negative[i] for i in order], float)
        self.names = [names[i] for i in order]
        ids = np.concatenate([points[i][0] for i in order]).astype(np.int32)
        weights = np.concatenate([points[i][1] for i in order]).astype(np.float32)
        self.size, self.blocks = len(order), -(-len(order) // BLOCK)
        place = np.repeat(np.arange(len(order)).astype(np.min_scalar_type(max(self.size, BLOCK))), sizes[order])
        common = np.flatnonzero(often > max(len(order) // 8, 32))
        #: Row of each common feature, -1 for the others.
        self.row = np.full(len(often), -1, np.int32)
        self.row[common] = np.arange(len(common))
        own = np.flatnonzero(self.row[ids] >= 0)
        self.common = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.common[place[own] // BLOCK, self.row[ids[own]], place[own] % BLOCK] = weights[own]
        self.most = self.common.max(axis=2).T.astype(float)  # of each common feature and block
        listed = np.flatnonzero(self.row[ids] < 0)
        #: Number of each light feature, -1 for the others.
        self.light = _light(ids, weights, listed, often)
        light = np.empty(len(listed), bool)
        for at in range(0, len(listed), SORTED):
            light[at : at + SORTED] = self.light[ids[listed[at : at + SORTED]]] >= 0
        own, listed = listed[light], listed[~light]
        del light
        #: Weights of the postings, after the lists the light ones by point.
        self.listed = np.empty(len(listed) + len(own), np.float32)
        self.listed[len(listed) :] = weights[own]
        self.features = self.light[ids[own]].astype(np.min_scalar_type(self.light.max(initial=0)))
        #: Light postings of each point up to its end, and the length that they have together.
        self.own_ends = np.cumsum(np.bincount(place[own], minlength=self.blocks * BLOCK))
        self.length = np.sqrt(np.bincount(place[own], np.square(weights[own], dtype=float), minlength=self.blocks * BLOCK))
        del own
        # Postings by feature and place, in few bytes: both are one number to sort.
        for at in range(0, len(listed), SORTED):
            some = listed[at : at + SORTED]
            some |= ids[some].astype(np.int64) << 32
        del ids
        listed.sort()
        self.places = np.empty(len(listed), place.dtype)
        sizes = np.zeros(len(often), np.int64)
        for at in range(0, len(listed), SORTED):
            some = listed[at : at + SORTED]
            sizes += np.bincount(some >> 32, minlength=len(often))
            some &= (1 << 32) - 1
            self.places[at : at + len(some)], self.listed[at : at + len(some)] = place[some], weights[some]
        self.ends = np.cumsum(sizes)

    def point(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and weights of a point, gathered from all lists."""
        at = np.flatnonzero(self.places == place)
        row = self.common[place // BLOCK, :, place % BLOCK]
        own = np.arange(self.own_ends[place - 1] if place else 0, self.own_ends[place])
        ids = [np.searchsorted(self.ends, at, side="right"), np.flatnonzero(self.light >= 0)[self.features[own]], np.flatnonzero(self.row >= 0)[row > 0]]
        weights = [self.listed[at], self.listed[len(self.places) + own], row[row > 0]]
        return np.concatenate(ids), np.concatenate(weights).astype(float)

    def _sums(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the listed features add to each point, up to the end of the last block."""
        end = self.ends[ids]
        first = np.where(ids > 0, self.ends[ids - 1], 0)
        size = end - first
        rare = np.flatnonzero((size > 0) & (size <= RARE))
        count = size[rare]
        at = np.repeat(first[rare] - np.cumsum(count) + count, count) + np.arange(count.sum())
        values = np.repeat(weights[rare], count) * self.listed[at]
        sums = np.bincount(self.places[at], values, minlength=self.blocks * BLOCK).astype(float, copy=False)
        for i in np.flatnonzero(size > RARE).tolist():
            own = slice(first[i], end[i])
            sums[self.places[own]] += weights[i] * self.listed[own]
        return sums

    def nearest(self, ids: np.ndarray, weights: np.ndarray, count: int, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, place) of the nearest points that stand for ``count`` examples, nearest first.

        Equal cosines are ordered by place. One example of the point ``skip`` is left out.
        Features that no point has are passed over.
        """
        return self.nearest_of_all([(ids, weights)], count, [skip])[0]

    def nearest_of_all(self, queries: list[tuple[np.ndarray, np.ndarray]], count: int, skips: list[int]) -> list[list[tuple[float, int]]]:
        """``nearest`` of some queries, which open a block together: one product for all of them.

        Products are of 32-bit numbers, so a block is opened, and a point kept, with ROUNDING to
        spare. The cosines of what is left are summed anew, the same in whatever company.
        """
        sums = np.zeros((len(queries), self.blocks * BLOCK))
        most = np.zeros((len(queries), self.blocks, BLOCK), np.float32)  # with what light features add at most
        by = np.zeros((len(queries), len(self.most)))
        length = np.zeros(len(queries))
        rest = []
        for i, (ids, weights) in enumerate(queries):
            known = ids < len(self.row)
            ids, weights = ids[known], weights[known]
            rows, light = self.row[ids], self.light[ids]
            by[i, rows[rows >= 0]] = weights[rows >= 0]
            rest.append((light[light >= 0], weights[light >= 0]))
            length[i] = np.sqrt(rest[i][1] @ rest[i][1])
            own = (rows < 0) & (light < 0)
            sums[i] = self._sums(ids[own], weights[own])
            np.add(sums[i], length[i] * self.length, out=most[i].reshape(-1), casting="same_kind")
        bound, few = most.max(axis=2) + by @ self.most, by.astype(np.float32)
        order = np.argsort(-bound, axis=1, kind="stable")
        found = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
        worst, at, step = np.zeros(len(queries)), 0, FIRST
        while at < self.blocks:
            some = order[:, at : at + step]
            reach = np.take_along_axis(bound, some, axis=1)
            query, column = np.nonzero((reach > 0) & (reach + ROUNDING >= worst[:, None]))
            if not len(query):
                break
            for owner, cosine, place in self._opened(most, few, length, query, some[query, column], worst):
                cosine, place = np.concatenate([found[owner][0], cosine]), np.concatenate([found[owner][1], place])
                found[owner], worst[owner] = self._trimmed(cosine, place, length[owner], count, skips[owner])
            at, step = at + step, 2 * step
        out, scattered = [], np.zeros(int(self.light.max(initial=-1)) + 1)
        for i, (cosine, place) in enumerate(found):
            # The first ones in full say what others must reach.
            first, others = place[: 2 * count], place[2 * count :]
            full = self._in_full(sums[i], by[i], *rest[i], first, scattered)
            near, held = self._ordered(full, first)
            end = self._enough(held, count, skips[i])
            if len(others) and end <= len(near):
                others = others[cosine[2 * count :] + length[i] * self.length[others] + ROUNDING >= near[end - 1]]
            if len(others):
                full = np.concatenate([full, self._in_full(sums[i], by[i], *rest[i], others, scattered)])
                near, held = self._ordered(full, np.concatenate([first, others]))
                end = self._enough(held, count, skips[i])
            end = min(end, int(np.count_nonzero(near > 0)))
            out.append(list(zip(near[:end].tolist(), held[:end].tolist())))
        return out

    def _in_full(self, sums: np.ndarray, by: np.ndarray, light: np.ndarray, weights: np.ndarray, place: np.ndarray, scattered: np.ndarray):
        """The cosines of these points."""
        rows = np.flatnonzero(by)
        common = self.common[place[:, None] // BLOCK, rows, place[:, None] % BLOCK]
        return sums[place] + (common * by[rows]).sum(axis=1) + self._light_sums(light, weights, place, scattered)

    def _light_sums(self, light: np.ndarray, weights: np.ndarray, place: np.ndarray, scattered: np.ndarray) -> np.ndarray:
        """What the light features add to these points; ``scattered`` is 0 for every feature."""
        end = self.own_ends[place]
        first = np.where(place > 0, self.own_ends[place - 1], 0)
        size = end - first
        at = np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())
        scattered[light] = weights
        values = scattered[self.features[at]] * self.listed[len(self.places) + at]
        scattered[light] = 0.0
        return np.bincount(np.repeat(np.arange(len(place)), size), values, minlength=len(place))

    def _opened(self, most: np.ndarray, by: np.ndarray, length: np.ndarray, query: np.ndarray, block: np.ndarray, worst: np.ndarray):
        """(query, sums without light features, places) of the points of opened blocks that may reach the query's worst."""
        owners, cosines, places = [], [], []
        floor = np.maximum(worst - ROUNDING, 1e-30).astype(np.float32)[:, None]
        order = np.argsort(block, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            opened, who = block[own[0]], query[own]
            cosine = by[who] @ self.common[opened]
            cosine += most[who, opened]
            at = np.flatnonzero(cosine >= floor[who])
            owners.append(who[at // BLOCK])
            cosines.append(cosine.reshape(-1)[at])
            places.append(at % BLOCK + opened * BLOCK)
        owner, cosine, place = (np.concatenate(column) for column in (owners, cosines, places))
        cosine = cosine - length[owner] * self.length[place]
        order = np.argsort(owner, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if len(own):
                yield int(owner[own[0]]), cosine[own], place[own]

    def _trimmed(self, cosine: np.ndarray, place: np.ndarray, length: float, count: int, skip: int):
        """The points that may be among those that hold ``count`` examples, and what others must reach.

        Cosines lack the light features, which add from nothing to the product of both lengths.
        """
        if len(cosine) > count + 1:  # each point but ``skip`` holds an example at least
            enough = np.partition(cosine, -(count + 1))[-(count + 1)] - 2 * ROUNDING
            kept = cosine + length * self.length[place] >= enough
            cosine, place = cosine[kept], place[kept]
        cosine, place = self._ordered(cosine, place)
        end = self._enough(place, count, skip)
        if end > len(cosine):
            return (cosine, place), 0.0
        worst = float(cosine[end - 1]) - 2 * ROUNDING
        kept = cosine + length * self.length[place] >= worst
        return (cosine[kept], place[kept]), worst

    @staticmethod
    def _ordered(cosine: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((place, -cosine))
        return cosine[order], place[order]

    def _enough(self, place: np.ndarray, count: int, skip: int) -> int:
        """How many of the points, in their order, hold ``count`` examples; more than there are if all do not."""
        return int(np.searchsorted(np.cumsum(self.total[place] - (place == skip)), count)) + 1

    def vote(self, ids: np.ndarray, weights: np.ndarray, count: int, prior: float, skip: int = -1, label: int = 0):
        """(share of positive examples among the nearest, weighted by nearness; the neighbours).

        ``prior`` counts as one example at the distance of the last neighbour. With ``skip``,
        one example of that point, labelled ``label``, does not vote.
        """
        near = self.nearest(ids, weights, count, skip)
        return self.share(near, count, prior, skip, label), near

    def share(self, near: list[tuple[float, int]], count: int, prior: float, skip: int = -1, label: int = 0) -> float:
        """The share of positive examples that ``vote`` gives for these neighbours."""
        left, yes, all_ = float(count), 0.0, 0.0
        weight = 1.0
        for cosine, place in near:
            own = place == skip
            total, positive = self.total[place] - own, self.positive[place] - (own and label)
            if total <= 0:
                continue
            used = min(left, total)
            weight = 1.0 / (NEAREST + max(0.0, 1.0 - cosine))
            yes += weight * used * positive / total
            all_ += weight * used
            left -= used
        # An only neighbour of cosine 1 must not make the prior as heavy as itself.
        weight = min(weight, 1.0) if left > 0 else weight
        return (yes + weight * prior) / (all_ + weight)


def _often(points: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many postings each feature has."""
    often = np.zeros(1, np.int64)
    for at in range(0, len(points), BLOCK):
        some = np.bincount(np.concatenate([ids for ids, _ in points[at : at + BLOCK]]).astype(np.int64), minlength=len(often))
        some[: len(often)] += often
        often = some
    return often


def _light(ids: np.ndarray, weights: np.ndarray, listed: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A number for each light feature, -1 for others: of all squared weights, light ones hold LIGHT at most."""
    squares, total = np.zeros(len(often)), 0.0
    for at in range(0, len(listed), SORTED):
        some = listed[at : at + SORTED]
        squares += np.bincount(ids[some], np.square(weights[some], dtype=float), minlength=len(often))
    for at in range(0, len(weights), SORTED):
        total += float(np.square(weights[at : at + SORTED], dtype=float).sum())
    order = np.argsort(squares / np.maximum(often, 1.0) ** 2, kind="stable")
    light = np.zeros(len(often), bool)
    light[order[np.cumsum(squares[order]) <= LIGHT * total]] = True
    light &= squares > 0
    return np.where(light, np.cumsum(light) - 1, -1).astype(np.int32)


def _kind(ids: np.ndarray, weights: np.ndarray, often: np.ndarray) -> tuple[int, int]:
    """Points of one most common and one heaviest feature stand together, which keeps bounds tight."""
    if not len(ids):
        return -1, -1
    heaviest = int(ids[weights.argmax()])
    return int(ids[often[ids].argmax()]), heaviest if often[heaviest] >= 8 else -1
