"""Lossless WebP in numpy: a decoder for the whole format, and an encoder for each of its tools.

Pixels are uint32 arrays of shape (height, width), 0xAARRGGBB.

Decoding is sequential by nature, as a symbol's place depends on the lengths of
all before it. So many images are decoded side by side, a symbol of each at every
step. Of an image of many pixels the next symbol's place is worked out for every
bit of the stream at once instead, by table look-ups on arrays; what stays
sequential is following these places from the first to the last symbol.
"""

import numpy as np

# Fixed values of the format.
_CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
_LENGTHS, _DISTANCES, _LONGEST_CODE = 24, 40, 15
_BLACK = 0xFF000000
# (columns to the left, rows up) of the short distance codes.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


def _ceil_div(a, bits):
    return (a + (1 << bits) - 1) >> bits


def _channels(argb):
    """Four int32 arrays: alpha, red, green, blue."""
    return tuple(((argb >> np.uint32(s)) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0))


def _join(a, r, g, b):
    a, r, g, b = (np.asarray(x).astype(np.uint32) & np.uint32(255) for x in (a, r, g, b))
    return (a << np.uint32(24)) | (r << np.uint32(16)) | (g << np.uint32(8)) | b


_BACKWARDS = [int(format(k, "08b")[::-1], 2) for k in range(256)]


def _canonical(lengths):
    """Code of every symbol as the stream holds it: first bit lowest."""
    codes, code = [0] * len(lengths), 0
    order = sorted([(n, s) for s, n in enumerate(lengths) if n])
    last = order[0][0] if order else 0
    for n, s in order:
        code <<= n - last
        last = n
        codes[s] = (_BACKWARDS[code & 255] << 8 | _BACKWARDS[code >> 8]) >> (16 - n)
        code += 1
    return codes


# ---------------------------------------------------------------- decoding


class _Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        if not n:
            return 0
        k = self.at >> 3
        value = (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value

    def peek(self, start, n):
        k = start >> 3
        return (int.from_bytes(self.data[k : (start + n + 7) >> 3], "little") >> (start & 7)) & ((1 << n) - 1)


#: Windows of 16 bits with their bits in the other order.
_TURNED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little"), axis=1).astype(np.int64) @ np.array([256, 1])


class _Code:
    """A prefix code: `table` holds symbol * 16 + length for every window of `bits` bits."""

    cache: dict = {}

    def __init__(self, lengths):
        sizes = np.array(lengths, dtype=np.int32)
        used = np.flatnonzero(sizes)
        self.largest = int(used[-1]) if len(used) else 0
        if len(used) < 2:  # takes no bits
            self.bits, self.table = 0, np.array([self.largest << 4])
            return
        used = used[np.argsort(sizes[used], kind="stable")]  # in the order of their codes
        sizes = sizes[used]
        self.bits = int(sizes[-1])
        spans = 1 << (self.bits - sizes)
        if spans.sum() != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        # Codes count upwards when read with the first bit highest; the stream holds it lowest.
        self.table = np.repeat(used << 4 | sizes, spans)[_TURNED[: 1 << self.bits] >> (16 - self.bits)]

    @classmethod
    def of(cls, lengths):
        key = bytes(lengths).rstrip(b"\0")
        if key not in cls.cache:
            if len(cls.cache) > 64:
                cls.cache.clear()
            cls.cache[key] = cls(lengths)
        return cls.cache[key]

    def by_window(self):
        """Symbols and sizes by window as the stream holds it, as lists; for short codes."""
        if not hasattr(self, "lists"):
            self.lists = (self.table >> 4).tolist(), (self.table & 15).tolist()
        return self.lists


def _read_code(bits, alphabet):
    """A code, and whether the same bits would describe it for another alphabet as well."""
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return _Code.of(lengths), True
    count, own = 4 + bits.read(4), [0] * 19
    three = bits.peek(bits.at, 3 * count)
    bits.at += 3 * count
    for s in _CODE_LENGTH_ORDER[:count]:
        own[s] = three & 7
        three >>= 3
    code = _Code.of(own)
    bounded = bits.read(1)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bounded else alphabet
    # At most 14 bits a symbol: the whole description is read from one integer.
    k, window = bits.at & 7, int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * alphabet + 2], "little")
    start, mask = k, (1 << code.bits) - 1
    window >>= k
    symbols, sizes = code.by_window()
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        w = window & 0x3FFF
        s, n = symbols[w & mask], sizes[w & mask]
        w >>= n
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            extra, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
            run = least + (w & ((1 << extra) - 1))
            if at + run > alphabet:
                raise ValueError("code lengths run over the alphabet")
            if value:
                lengths[at : at + run] = [value] * run
            at, n = at + run, n + extra
        window >>= n
        k += n
    bits.at += k - start
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return _Code.of(lengths), bool(bounded) and left == 0


def _read_codes(bits, alphabets):
    """One code per alphabet; one that is described by the same bits as the code before it isn't read anew."""
    codes, last, size, content, anywhere = [], None, 0, 0, False
    for n in alphabets:
        if (n == last or (anywhere and codes[-1].largest < n)) and bits.peek(bits.at, size) == content:
            codes.append(codes[-1])
            bits.at += size
            continue
        start = bits.at
        code, anywhere = _read_code(bits, n)
        codes.append(code)
        last, size = n, bits.at - start
        content = bits.peek(start, size)
    return codes


class _Symbols:
    """The symbols of an entropy-coded image that are to be read next: where they begin, and their codes by group."""

    def __init__(self, bits, width, total, cache_bits, tiles, groups, main):
        self.bits, self.width, self.total, self.cache_bits, self.tiles, self.groups, self.main = bits, width, total, cache_bits, tiles, groups, main


def _entropy_image(bits, width, height, main):
    """Steps of reading an entropy-coded image; yields _Symbols, is sent pixels, and returns them as a flat array."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tiles, groups = None, 1
    if main and bits.read(1):
        tile_bits = 2 + bits.read(3)
        tiles_wide = _ceil_div(width, tile_bits)
        meta = yield from _entropy_image(bits, tiles_wide, _ceil_div(height, tile_bits), False)
        of_tile = (meta >> np.uint32(8)) & np.uint32(0xFFFF)
        y, x = np.divmod(np.arange(width * height), width)
        tiles = of_tile[(y >> tile_bits) * tiles_wide + (x >> tile_bits)].astype(np.int64)
        groups = int(of_tile.max()) + 1
    alphabets = (256 + _LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, _DISTANCES)
    codes = [_read_codes(bits, alphabets) for _ in range(groups)]
    return (yield _Symbols(bits, width, width * height, cache_bits, tiles, codes, main))


def _prefix_value(prefix, window):
    """Value and extra bits of a length or distance prefix, from the bits that follow it."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    offset = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return offset + (window & ((1 << extra) - 1)) + 1, extra


class _Places:
    """Windows and codes of many images: all bytes one after the other, and all tables in one."""

    def __init__(self, wanted):
        data, begins, tables, at, place = [], [], {}, 0, 0
        for s in wanted:
            data.append(s.bits.data[s.bits.at >> 3 :])
            begins.append(8 * at + (s.bits.at & 7))
            at += len(data[-1])
            for five in s.groups:
                for code in five:
                    if id(code) not in tables:
                        tables[id(code)] = place, code.table
                        place += len(code.table)
        self.begins = np.array(begins, dtype=np.int64)
        self.end = 8 * at + 1
        content = b"".join(data) + bytes(24)
        self.words = np.ndarray((len(content) - 7,), dtype="<i8", buffer=content, strides=(1,))
        self.table = np.concatenate([t for _, t in tables.values()])
        # Of every group of every image, for each of the five codes: where its table begins, and the mask of its windows.
        rows = [[(tables[id(code)][0], (1 << code.bits) - 1) for code in five] for s in wanted for five in s.groups]
        self.base, self.mask = np.array(rows, dtype=np.int64).reshape(-1, 5, 2).transpose(2, 1, 0).copy()
        self.first_group = np.cumsum([0] + [len(s.groups) for s in wanted[:-1]])

    def window(self, at):
        """57 bits from each place on; the bits above are of no use."""
        return self.words[at >> 3] >> (at & 7)

    def far(self, group, window):
        """Symbol * 16 + length of the distance code at each window."""
        return self.table[self.base[4][group] + (window & self.mask[4][group])]


def _read_symbols(wanted):
    """Pixels of many images, the largest first: one symbol of every image at each step, so that the steps are few and their work is wide."""
    total = np.array([s.total for s in wanted])
    places = _Places(wanted)
    n, steps = len(wanted), int(total[0])
    at, pixel = places.begins.copy(), np.zeros(n, dtype=np.int64)
    several = any(len(s.groups) > 1 for s in wanted)
    plain = not several and all(five[0].largest < 256 for s in wanted for five in s.groups)
    short = all(sum(code.bits for code in five[:4]) <= 57 for s in wanted for five in s.groups)
    active = np.searchsorted(-total, -np.arange(steps), side="left")  # images with more pixels than steps went by
    found = np.zeros((4, steps, n), dtype=np.uint16)  # of green, red, blue, alpha
    where, copies = None if plain else np.full((steps, n), 1 << 40, dtype=np.int64), []
    if several:
        tiles = np.concatenate([s.tiles if s.tiles is not None else np.zeros(s.total, dtype=np.int64) for s in wanted])
        tiles_from = np.cumsum(total) - total
    last, group, m, table, words = at.copy(), places.first_group, n, places.table, places.words
    base, mask = places.base[:4, group], places.mask[:4, group]
    for step in range(steps):
        if active[step] < m:
            now = int(active[step])
            last[now:m] = at[now:]
            m = now
            at, pixel, group, total = at[:m], pixel[:m], group[:m], total[:m]
            base, mask = base[:, :m], mask[:, :m]
        if several:
            group = places.first_group[:m] + tiles[tiles_from[:m] + np.minimum(pixel, total - 1)]
            base, mask = places.base[:4, group], places.mask[:4, group]
        window, used = words[at >> 3] >> (at & 7), 0
        for c in range(4):
            if c == 3 and not short:
                window = places.window(at + used)
            here = table.take((window & mask[c]) + base[c])
            found[c, step, :m] = here
            here &= 15
            if c < 3:
                window >>= here
            used = used + here
        if plain:
            at = np.minimum(at + used, places.end)
            continue
        open_ = pixel < total
        if not step & 15 and not open_.any():
            break
        where[step, :m] = pixel
        advance, used = open_.astype(np.int64), used * open_
        first = found[0, step, :m]
        special = np.flatnonzero((first >= 256 << 4) & open_)
        if len(special):
            first = first.astype(np.int64)
            used[special] = first[special] & 15
            some = special[first[special] < (256 + _LENGTHS) << 4]
            here = np.minimum(at[some] + (first[some] & 15), places.end)
            length, extra = _prefix_value((first[some] >> 4) - 256, places.window(here))
            here = np.minimum(here + extra, places.end)
            code = places.far(group[some], places.window(here))
            here = np.minimum(here + (code & 15), places.end)
            far, extra = _prefix_value(code >> 4, places.window(here))
            used[some], advance[some] = here + extra - at[some], length
            copies.append((np.full(len(some), step), some, length, far))
        at, pixel = np.minimum(at + used, places.end), pixel + advance
    last[:m] = at
    for s, begin, end in zip(wanted, places.begins.tolist(), last.tolist(), strict=True):
        s.bits.at += end - begin
        if s.bits.at > 8 * len(s.bits.data):
            raise ValueError("the stream ends early")
    found >>= 4
    green = found[0]
    colour = _join(found[3], found[1], green, found[2])
    if plain:
        return [c[: s.total] for s, c in zip(wanted, np.ascontiguousarray(colour.T), strict=True)]
    own = [{} for _ in wanted]
    for step, image, length, far in zip(*(np.concatenate(x).tolist() for x in zip(*copies, strict=True)), strict=True) if copies else ():
        own[image][step] = length, far
    columns = zip(np.ascontiguousarray(green.T), np.ascontiguousarray(colour.T), np.ascontiguousarray(where.T), own, strict=True)
    return [_resolve(s, *column) for s, column in zip(wanted, columns, strict=True)]


def _resolve(s, green, colour, where, copies):
    """Pixels of one image with copies or cache codes, which need what stands before them and so go in order."""
    out = np.zeros(s.total, dtype=np.uint32)
    count = int(np.searchsorted(where, s.total))
    green, colour, where = green[:count], colour[:count], where[:count]
    literal = green < 256
    out[where[literal]] = colour[literal]
    cache, cached = [0] * (1 << s.cache_bits), 0
    special = np.flatnonzero(~literal)
    for step, g, k in zip(special.tolist(), green[special].tolist(), where[special].tolist(), strict=True):
        if g < 256 + _LENGTHS:
            n, far = copies[step]
            if far > len(_NEAR):
                far -= len(_NEAR)
            else:
                x, y = _NEAR[far - 1]
                far = max(1, x + y * s.width)
            if far > k or k + n > s.total:
                raise ValueError("a copy reaches outside the image")
            out[k : k + n] = out[k - far : k - far + n] if far >= n else np.resize(out[k - far : k], n)
        else:
            for value in out[cached:k].tolist():
                cache[((_HASH * value) & 0xFFFFFFFF) >> (32 - s.cache_bits)] = value
            cached = k
            out[k] = cache[g - 256 - _LENGTHS]
    return out


#: Images with more pixels are laid out, each for itself.
_WIDE = 4096
#: At most so many symbols are held at once.
_MOST_CELLS = 3_000_000


class _Group:
    """One group's five codes, and for a stretch of the stream each bit's symbol and where the next begins."""

    def __init__(self, codes):
        self.codes = codes

    def lay_out(self, windows, bits):
        """windows: the 32 bits from each bit on, uint32, with 64 more at the end than the stream has bits."""
        here = np.arange(bits, dtype=np.int32)
        green, red, blue, alpha, distance = self.codes

        def read(code, at):
            return code.table[windows[at] & np.uint32((1 << code.bits) - 1)]

        def pass_by(code, at):
            return at + (read(code, at) & 15) if code.bits else at

        found = read(green, here)
        sym, at = found >> 4, here + (found & 15)
        self.symbol, self.after_green = sym, at
        following = pass_by(alpha, pass_by(blue, pass_by(red, at)))
        if green.largest >= 256:
            following = np.where(sym < 256, following, at)
            copies = np.flatnonzero((sym >= 256) & (sym < 256 + _LENGTHS))
            if len(copies):
                start = at[copies].astype(np.int64)
                length, extra = _prefix_value((sym[copies] - 256).astype(np.int64), windows[start].astype(np.int64))
                start = start + np.minimum(extra, 18)
                prefix = read(distance, start) >> 4
                start = pass_by(distance, start)
                far, extra = _prefix_value(prefix.astype(np.int64), windows[start].astype(np.int64))
                following[copies] = start + np.minimum(extra, 18)
                self.copy = np.full(bits, -1, dtype=np.int32)
                self.copy[copies] = np.arange(len(copies))
                self.copy_length, self.copy_far = length, far
        self.following = following

    def literals(self, windows, at):
        """Pixels of the literals that begin at these bits."""
        values, place = [self.symbol[at]], self.after_green[at]
        for code in self.codes[1:4]:
            found = code.table[windows[place] & np.uint32((1 << code.bits) - 1)]
            values.append(found >> 4)
            place = place + (found & 15)
        g, r, b, a = values
        return _join(a, r, g, b)


def _read_wide(s):
    """Pixels of one image, by following places that are worked out for every bit."""
    bits, total = s.bits, s.total
    first, rest = bits.at, bits.data[bits.at >> 3 :]
    size = 8 * len(rest) - (first & 7) + 1
    words = np.ndarray((len(rest) + 8,), dtype="<u8", buffer=rest + bytes(16), strides=(1,))
    windows = np.right_shift.outer(words, np.arange(8, dtype=np.uint64)).astype(np.uint32).ravel()[first & 7 :]
    groups = [_Group(codes) for codes in s.groups]
    for g in groups:
        g.lay_out(windows, size)
    seen = np.zeros((total, 3), dtype=np.int64)  # place in the stream, pixel, group
    tiles = s.tiles.tolist() if s.tiles is not None else None
    follow, symbols = [memoryview(g.following) for g in groups], [memoryview(g.symbol) for g in groups]
    p = k = n = g = 0
    while k < total:
        if tiles:
            g = tiles[k]
        if p >= size:
            raise ValueError("the stream ends early")
        seen[n] = p, k, g
        n += 1
        if 256 <= symbols[g][p] < 256 + _LENGTHS:
            k += int(groups[g].copy_length[groups[g].copy[p]])
        else:
            k += 1
        p = follow[g][p]
    bits.at = first + p
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    seen = seen[:n]
    green, colour, copies = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint32), {}
    for number, g in enumerate(groups):
        own = np.flatnonzero(seen[:, 2] == number)
        at = seen[own, 0]
        green[own] = g.symbol[at]
        plain = g.symbol[at] < 256
        colour[own[plain]] = g.literals(windows, at[plain])
        far = (g.symbol[at] >= 256) & (g.symbol[at] < 256 + _LENGTHS)
        if far.any():
            which = g.copy[at[far]]
            copies.update(zip(own[far].tolist(), zip(g.copy_length[which].tolist(), g.copy_far[which].tolist(), strict=True), strict=True))
    return _resolve(s, green, colour, seen[:, 1], copies)


def _read_all(wanted):
    """Pixels of each of the images."""
    found = [_read_wide(s) if s.total > _WIDE else None for s in wanted]
    narrow = sorted((k for k, s in enumerate(wanted) if s.total <= _WIDE), key=lambda k: -wanted[k].total)
    while narrow:
        n = max(1, _MOST_CELLS // wanted[narrow[0]].total)
        some, narrow = narrow[:n], narrow[n:]
        for k, pixels in zip(some, _read_symbols([wanted[k] for k in some]), strict=True):
            found[k] = pixels
    return found


def _average(a, b):
    """Of two packed pixels, by channel and rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _plus(a, b):
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _minus(a, b):
    """a - b by channel."""
    return sum(((((a >> s) & 255) - ((b >> s) & 255)) & 255) << s for s in (0, 8, 16, 24))


def _clamp(x):
    return 0 if x < 0 else 255 if x > 255 else x


def _predicted(mode, left, top, right, corner):
    """right: above to the right; corner: above to the left."""
    if mode in (0, 14, 15):
        return _BLACK
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    parts = [((left >> s) & 255, (top >> s) & 255, (corner >> s) & 255, s) for s in (0, 8, 16, 24)]
    if mode == 11:  # whichever of left and top is nearer to left + top - corner
        to_left = sum(abs(t - c) for _, t, c, _ in parts)
        to_top = sum(abs(x - c) for x, _, c, _ in parts)
        return left if to_left < to_top else top
    if mode == 12:
        return sum(_clamp(x + t - c) << s for x, t, c, s in parts)
    halves = [((x + t) >> 1, c, s) for x, t, c, s in parts]
    return sum(_clamp(m + int((m - c) / 2)) << s for m, c, s in halves)


def _walk_predictor(pixels, width, height, modes, size_bits, back):
    """Residuals of pixels, or with `back` the pixels of residuals."""
    out = pixels.tolist()
    source = out if back else pixels.tolist()
    wide, modes = _ceil_div(width, size_bits), ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    apply = _plus if back else _minus
    for y in range(height):
        for x in range(width):
            k = y * width + x
            if y == 0:
                guess = source[k - 1] if x else _BLACK
            elif x == 0:
                guess = source[k - width]
            else:
                # The right neighbour above the last column is the first pixel of this row.
                guess = _predicted(modes[(y >> size_bits) * wide + (x >> size_bits)], source[k - 1], source[k - width], source[k - width + 1], source[k - width - 1])
            out[k] = apply(source[k], guess)
    return np.array(out, dtype=np.uint32)


def _signed(x):
    return ((x + 128) & 255) - 128


def _cross(pixels, width, height, table, size_bits, sign):
    """Add (sign 1) or take away (-1) what green and red say of red and blue."""
    y, x = np.divmod(np.arange(width * height), width)
    _, red_to_blue, green_to_blue, green_to_red = (_signed(c) for c in _channels(table[(y >> size_bits) * _ceil_div(width, size_bits) + (x >> size_bits)]))
    a, r, g, b = _channels(pixels)
    new_r = (r + sign * ((green_to_red * _signed(g)) >> 5)) & 255
    real_r = new_r if sign > 0 else r
    new_b = b + sign * (((green_to_blue * _signed(g)) >> 5) + ((red_to_blue * _signed(real_r)) >> 5))
    return _join(a, new_r, g, new_b)


def _subtract_green(pixels, sign):
    a, r, g, b = _channels(pixels)
    return _join(a, r + sign * g, g, b + sign * g)


def _decoding(data):
    """Steps of decoding a VP8L chunk's content; yields _Symbols, is sent their pixels, and returns the image."""
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha, version = bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, full_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform comes twice")
        if kind < 2:
            size_bits = 2 + bits.read(3)
            undo.append((kind, width, size_bits, (yield from _entropy_image(bits, _ceil_div(width, size_bits), _ceil_div(height, size_bits), False))))
        elif kind == 2:
            undo.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            deltas = _channels((yield from _entropy_image(bits, n, 1, False)))
            palette = _join(*(np.cumsum(c) for c in deltas))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, pack, palette))
            width = _ceil_div(width, pack)
    pixels = yield from _entropy_image(bits, width, height, True)
    for kind, wide, size_bits, table in reversed(undo):
        if kind == 0:
            pixels = _walk_predictor(pixels, wide, height, table, size_bits, True)
        elif kind == 1:
            pixels = _cross(pixels, wide, height, table, size_bits, 1)
        elif kind == 2:
            pixels = _subtract_green(pixels, 1)
        else:
            each, depth = 1 << size_bits, 8 >> size_bits
            green = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            index = np.stack([(green >> np.uint32(k * depth)) & np.uint32((1 << depth) - 1) for k in range(each)], axis=2).reshape(height, -1)[:, :wide].ravel()
            pixels = np.concatenate([table, np.zeros(256, dtype=np.uint32)])[index]
    if not alpha:
        pixels = pixels | np.uint32(_BLACK)
    return pixels.reshape(height, full_width)


def decode_many(contents):
    """Pixels of each of many VP8L chunks' contents, decoded side by side."""
    found, running = [None] * len(contents), [(k, _decoding(data), None) for k, data in enumerate(contents)]
    held = []
    while running:
        waiting = held
        for k, steps, pixels in running:
            try:
                waiting.append((k, steps, steps.send(pixels)))
            except StopIteration as end:
                found[k] = end.value
        # What describes images goes first, so that the images themselves are read together.
        now = [w for w in waiting if not w[2].main] or waiting
        pixels = dict(zip((k for k, _, _ in now), _read_all([s for _, _, s in now]), strict=True))
        running = [(k, steps, pixels[k]) for k, steps, _ in now]
        held = [w for w in waiting if w[0] not in pixels]
    return found


def decode_vp8l(data):
    """Pixels of a VP8L chunk's content."""
    return decode_many([data])[0]


def webp_contents(data):
    """The VP8L chunks' contents of concatenated WebP files, plain or extended; other chunks (metadata) are passed over."""
    found, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end, k, known = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12, len(found)
        while k + 8 <= end:
            size = int.from_bytes(data[k + 4 : k + 8], "little")
            if data[k : k + 4] == b"VP8L":
                found.append(data[k + 8 : k + 8 + size])
            k += 8 + size + size % 2
        if len(found) != known + 1:
            raise ValueError("not a lossless WebP file of one image")
        at = end
    return found


def decode_webp(data):
    """All lossless images of concatenated WebP files."""
    return decode_many(webp_contents(data))


# ---------------------------------------------------------------- encoding


class _Writer:
    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, value, size):
        self.values.append(np.array([value], dtype=np.int64))
        self.sizes.append(np.array([size], dtype=np.int64))

    def put_all(self, values, sizes):
        self.values.append(values)
        self.sizes.append(sizes)

    def done(self):
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        return np.packbits(((np.repeat(values, sizes) >> within) & 1).astype(np.uint8), bitorder="little").tobytes()


def _code_lengths(counts):
    """Huffman lengths of at most 15 bits; counts is a list."""
    import heapq

    while True:
        heap = [(n, s, None) for s, n in enumerate(counts) if n]
        if len(heap) < 2:
            return [int(n > 0) for n in counts]
        heapq.heapify(heap)
        mark = len(counts)
        while len(heap) > 1:
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (x[0] + y[0], mark, (x, y)))
            mark += 1
        lengths, stack = [0] * len(counts), [(heap[0], 0)]
        while stack:
            (_, s, pair), depth = stack.pop()
            if pair is None:
                lengths[s] = depth
            else:
                stack += [(pair[0], depth + 1), (pair[1], depth + 1)]
        if max(lengths) <= _LONGEST_CODE:
            return lengths
        counts = [n and (n >> 1) + 1 for n in counts]


# Lengths of the code of code lengths that the encoder writes always: a complete code of 18 symbols.
_OWN = [4] * 13 + [5, 5, 5, 0, 5, 4]
_OWN_CODES = _canonical(_OWN)
_OWN_HEAD = [_OWN[s] for s in _CODE_LENGTH_ORDER]


def _code_description(lengths):
    """Values and sizes that describe a prefix code, and the codes and sizes to write symbols with."""
    out = _Writer()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        out.put(1 | (len(used) - 1) << 1 | 1 << 2 | used[0] << 3, 11)
        if len(used) == 2:
            out.put(used[1], 8)
    else:
        values, sizes = [0, 15, *_OWN_HEAD, 0], [1, 4, *[3] * 19, 1]
        at, end = 0, len(lengths)
        while at < end:
            n = lengths[at]
            if n:
                values.append(_OWN_CODES[n])
                sizes.append(_OWN[n])
                at += 1
                continue
            stop = at
            while stop < end and not lengths[stop] and stop - at < 138:
                stop += 1
            run = stop - at
            s, least, extra = (18, 11, 7) if run >= 11 else (17, 3, 3) if run >= 3 else (0, 1, 0)
            run = run if run >= 3 else 1
            values.append(_OWN_CODES[s] | (run - least) << _OWN[s])
            sizes.append(_OWN[s] + extra)
            at += run
        out.put_all(*np.array([values, sizes], dtype=np.int64))
    codes = np.array(_canonical(lengths), dtype=np.int64)
    sizes = np.array(lengths if len(used) > 1 else [0] * len(lengths), dtype=np.int64)
    return np.concatenate(out.values), np.concatenate(out.sizes), (codes, sizes)


def _prefix(value):
    """Prefix, extra bits' value and number of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


def find_copies(flat, least=4, longest=4096):
    """(place, length, distance) of stretches that repeat the latest earlier stretch with the same two pixels."""
    n = len(flat)
    if n < 8:
        return []
    pairs = (flat[:-1].astype(np.uint64) << np.uint64(32)) | flat[1:].astype(np.uint64)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    far = np.zeros(n - 1, dtype=np.int64)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    edges = np.flatnonzero(np.diff(far, prepend=-1, append=-1))
    found = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if far[a] and b - a + 1 >= least:
            a = max(a, found[-1][0] + found[-1][1]) if found else a
            while b + 1 - a >= least:
                size = min(longest, b + 1 - a)
                found.append((a, size, int(far[b - 1])))
                a += size
    return found


def _put_pixels(out, pixels, width, main, cache_bits=0, copies=(), tiles=None):
    """Write an entropy-coded image; tiles: (bits, group of each tile) for several groups of codes."""
    total = len(pixels)
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_of = np.zeros(total, dtype=np.int64)
    if main:
        out.put(bool(tiles), 1)
        if tiles:
            out.put(tiles[0] - 2, 3)
            wide = _ceil_div(width, tiles[0])
            _put_pixels(out, np.asarray(tiles[1], dtype=np.uint32).ravel() << np.uint32(8), wide, False)
            y, x = np.divmod(np.arange(total), width)
            group_of = np.asarray(tiles[1]).ravel()[(y >> tiles[0]) * wide + (x >> tiles[0])]
    a, r, g, b = _channels(pixels)
    green, own = g.astype(np.int64), np.ones(total, dtype=bool)
    if cache_bits:
        key = ((pixels.astype(np.uint64) * np.uint64(_HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        order = np.argsort(key, kind="stable")
        hit = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        green[order[1:][hit]] = 256 + _LENGTHS + key[order[1:][hit]].astype(np.int64)
    extras = {}
    for k, n, far in copies:
        own[k + 1 : k + n] = False
        prefix, bits, size = _prefix(n)
        far_prefix, far_bits, far_size = _prefix(far + len(_NEAR))
        green[k] = 256 + prefix
        extras[k] = (bits, size, far_prefix, far_bits, far_size)
    alphabet = 256 + _LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    codes = []
    for number in range(int(group_of.max()) + 1):
        inside = own & (group_of == number)
        literal = inside & (green < 256)
        plain = [np.bincount(c[literal], minlength=256) for c in (r, b, a)]
        counts = np.bincount(green[inside], minlength=alphabet)
        if main and not tiles:  # one code serves all channels, as their values are much alike
            counts[:256] += sum(plain)
            plain = [counts[:256]] * 3
        memo, lengths = {}, []
        for c in (counts, *plain):
            used = c if c[256:].any() else c[:256]
            key = used.tobytes()
            if key not in memo:
                memo[key] = _code_lengths(used.tolist())
            lengths.append(memo[key] + [0] * (len(c) - len(used)))
        far = np.bincount([extras[k][2] for k in extras if group_of[k] == number], minlength=_DISTANCES)
        lengths.append(_code_lengths(far.tolist()))
        described, five = {}, []
        for own_lengths in lengths:
            key = (len(own_lengths), bytes(own_lengths))
            if key not in described:
                described[key] = _code_description(own_lengths)
            out.put_all(*described[key][:2])
            five.append(described[key][2])
        codes.append(five)
    places = np.flatnonzero(own)
    values, sizes = np.zeros((len(places), 4), dtype=np.int64), np.zeros((len(places), 4), dtype=np.int64)
    is_literal = green[places] < 256
    for number, five in enumerate(codes):
        mine = group_of[places] == number
        for column, (channel, (code, size)) in enumerate(zip((green, r, b, a), five[:4], strict=True)):
            rows = mine if not column else mine & is_literal
            values[rows, column] = code[channel[places[rows]]]
            sizes[rows, column] = size[channel[places[rows]]]
    row_of = {int(k): row for row, k in enumerate(places)} if extras else {}
    for k, (bits, size, far_prefix, far_bits, far_size) in extras.items():
        code, width_of = codes[group_of[k]][4]
        values[row_of[k], 1:] = bits, code[far_prefix], far_bits
        sizes[row_of[k], 1:] = size, width_of[far_prefix], far_size
    out.put_all(values.ravel(), sizes.ravel())


def encode_vp8l(image, predictor=None, cross=None, subtract_green=False, palette=False, cache_bits=0, copies=False, tiles=None):
    """A VP8L chunk's content.

    copies: True to look for them, or a list as find_copies gives it.
    predictor: (size bits, mode of each block); cross: (size bits, pixels of
    multipliers of each block); tiles: (size bits, code group of each tile).
    """
    height, width = image.shape
    pixels = image.astype(np.uint32).ravel()
    out = _Writer()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        n = len(colours)
        if n > 256:
            raise ValueError("a palette holds 256 colours")
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        out.put(1 | 3 << 1 | (n - 1) << 3, 11)
        _put_pixels(out, _join(*(np.diff(c, prepend=0) for c in _channels(colours))), n, False)
        each, depth, wide = 1 << pack, 8 >> pack, _ceil_div(width, pack)
        padded = np.zeros((height, wide * each), dtype=np.uint32)
        padded[:, :width] = index.reshape(height, width)
        green = sum(padded[:, k::each] << np.uint32(k * depth) for k in range(each))
        pixels, width = (green.astype(np.uint32) << np.uint32(8)).ravel() | np.uint32(_BLACK), wide
    if subtract_green:
        out.put(1 | 2 << 1, 3)
        pixels = _subtract_green(pixels, -1)
    if predictor:
        modes = np.asarray(predictor[1], dtype=np.uint32).ravel() << np.uint32(8)
        out.put(1 | 0 << 1 | (predictor[0] - 2) << 3, 6)
        _put_pixels(out, modes, _ceil_div(width, predictor[0]), False)
        pixels = _walk_predictor(pixels, width, height, modes, predictor[0], False)
    if cross:
        table = np.asarray(cross[1], dtype=np.uint32).ravel()
        out.put(1 | 1 << 1 | (cross[0] - 2) << 3, 6)
        _put_pixels(out, table, _ceil_div(width, cross[0]), False)
        pixels = _cross(pixels, width, height, table, cross[0], -1)
    out.put(0, 1)
    _put_pixels(out, pixels, width, True, cache_bits, find_copies(pixels) if copies is True else copies or (), tiles)
    return out.done()


# ---------------------------------------------------------------- encoding many images side by side

_SHORT = 12


def _many_code_lengths(counts, most=_SHORT):
    """Huffman lengths of at most `most` bits for each row of counts, with two or more used symbols in each."""
    n, width = counts.shape
    out = np.zeros((n, width), dtype=np.int64)
    rows = np.arange(n)
    while len(rows):
        lengths = _huffman(counts[rows])
        fits = lengths.max(axis=1) <= most
        out[rows[fits]] = lengths[fits]
        rows = rows[~fits]
        counts = counts.copy()
        counts[rows] = np.where(counts[rows] > 0, (counts[rows] >> 1) + 1, 0)
    return out


def _huffman(counts):
    """Huffman lengths by two queues, a merge of every row at each step."""
    n, width = counts.shape
    far = np.int64(1) << 60
    values = np.where(counts > 0, counts, far)
    order = np.argsort(values, axis=1, kind="stable")
    leaves = np.concatenate([np.take_along_axis(values, order, axis=1), np.full((n, 2), far)], axis=1)
    used = (counts > 0).sum(axis=1)
    most = int(used.max())
    inner = np.full((n, most + 2), far)  # sums, in the order they are made, which is ascending
    parent = np.zeros((n, width + most + 2), dtype=np.int64)
    leaf, node, every = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
    for step in range(most - 1):
        rows = every[used - 1 > step]
        total = np.zeros(len(rows), dtype=np.int64)
        for _ in range(2):
            a, b = leaves[rows, leaf[rows]], inner[rows, node[rows]]
            is_leaf = a <= b
            total += np.where(is_leaf, a, b)
            parent[rows, np.where(is_leaf, leaf[rows], width + node[rows])] = step
            leaf[rows] += is_leaf
            node[rows] += ~is_leaf
        inner[rows, step] = total
    depth = np.zeros((n, most + 2), dtype=np.int64)
    for step in range(most - 3, -1, -1):
        rows = every[used - 2 > step]
        depth[rows, step] = depth[rows, parent[rows, width + step]] + 1
    sorted_lengths = np.where(np.arange(width) < used[:, None], np.take_along_axis(depth, parent[:, :width], axis=1) + 1, 0)
    lengths = np.zeros((n, width), dtype=np.int64)
    np.put_along_axis(lengths, order, sorted_lengths, axis=1)
    return lengths


def _many_canonical(lengths):
    """Codes of every row's symbols as the stream holds them: first bit lowest."""
    n, width = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    sizes = np.take_along_axis(lengths, order, axis=1)
    spans = np.where(sizes > 0, np.int64(1) << (16 - sizes), 0)
    codes = np.zeros((n, width), dtype=np.int64)
    np.put_along_axis(codes, order, np.where(sizes > 0, np.cumsum(spans, axis=1) - spans, 0), axis=1)
    return _TURNED[codes].astype(np.int64)


_OWN_CODE_OF, _OWN_SIZE_OF = np.array(_OWN_CODES, dtype=np.int64), np.array(_OWN, dtype=np.int64)


def _many_descriptions(lengths):
    """(row, value, size, code lengths told) of what describes each row as a prefix code up to its last used symbol, in order."""
    n, width = lengths.shape
    flat, place = lengths.ravel(), np.arange(n * width)
    zero, begins = flat == 0, place % width == 0
    breaks = ~zero | begins | np.append(False, ~zero[:-1])
    offset = place - np.maximum.accumulate(np.where(breaks, place, 0))
    last = width - 1 - np.argmax(lengths[:, ::-1] > 0, axis=1)
    piece = zero & (offset % 138 == 0) & (place % width < np.repeat(last, width))
    # A run of zeros ends at the next symbol that is used.
    edge = np.flatnonzero(~zero)
    kept = np.flatnonzero(~zero | piece)
    run = np.minimum(138, edge[np.searchsorted(edge, kept)] - kept)
    s = flat[kept]
    long_, middle, two = run >= 11, run >= 3, run == 2
    value = np.where(long_, _OWN_CODE_OF[18] | (run - 11) << _OWN[18], np.where(middle, _OWN_CODE_OF[17] | (run - 3) << _OWN[17], np.where(two, _OWN_CODE_OF[0] << _OWN[0] | _OWN_CODE_OF[0], _OWN_CODE_OF[0])))
    size = np.where(long_, _OWN[18] + 7, np.where(middle, _OWN[17] + 3, np.where(two, 2 * _OWN[0], _OWN[0])))
    return kept // width, np.where(s > 0, _OWN_CODE_OF[s], value), np.where(s > 0, _OWN_SIZE_OF[s], size), 1 + (two & (s == 0))


def _before(rows, sizes, n):
    """Per item the sum of the sizes before it in its row, and the sums of the n rows; items are sorted by row."""
    ends = np.cumsum(sizes)
    sums = np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)
    return ends - sizes - (np.cumsum(sums) - sums)[rows], sums


def encode_plain(images):
    """VP8L contents of many images by prefix codes alone; each image holds three or more different bytes."""
    n = len(images)
    flat = np.concatenate([image.ravel() for image in images]).astype("<u4")
    sizes = np.array([image.size for image in images])
    owner = np.repeat(np.arange(n), sizes)
    channels = flat.view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    # One code serves all channels, as their values are much alike.
    counts = np.bincount((owner[:, None] * 256 + channels).ravel(), minlength=n * 256).reshape(n, 256)
    lengths = _many_code_lengths(counts)
    codes = _many_canonical(lengths)

    heads = np.array([0x2F | (i.shape[1] - 1) << 8 | (i.shape[0] - 1) << 22 | 1 << 36 for i in images], dtype=np.int64)
    own_head = 15 << 1 | sum(x << (5 + 3 * k) for k, x in enumerate(_OWN_HEAD))
    key = (owner[:, None] * 256 + channels)[:, [1, 2, 0, 3]]
    value, key_size = codes.ravel()[key], lengths.ravel()[key]
    shifts = np.cumsum(key_size, axis=1) - key_size
    value, key_size = (value << shifts).sum(axis=1), key_size.sum(axis=1)

    items, at = [], np.zeros(n, dtype=np.int64)

    def put_one(value, size):
        nonlocal at
        items.append((np.arange(n), at, np.broadcast_to(value, n)))
        at = at + size

    def put_many(rows, values, sizes):
        nonlocal at
        within, sums = _before(rows, sizes, n)
        items.append((rows, at[rows] + within, values))
        at = at + sums

    *described, told = _many_descriptions(lengths)
    told = np.bincount(described[0], weights=told, minlength=n).astype(np.int64)
    put_one(heads, 43)  # no transform, no cache, one group of codes
    for _ in range(4):
        put_one(own_head, 62)
        put_one(1 | 3 << 1 | (told - 2) << 4, 12)
        put_many(*described)
    put_one(1 | 1 << 2, 11)  # distances: one symbol
    put_many(owner, value, key_size)

    room = (at + 63) // 64 + 1
    begin = np.cumsum(room) - room
    rows, places, values = (np.concatenate(x) for x in zip(*items, strict=True))
    places = places + 64 * begin[rows]
    word, low = places >> 6, (places & 63).astype(np.uint64)
    values = values.astype(np.uint64)
    out = np.zeros(int(room.sum()) + 1, dtype=np.uint64)
    np.add.at(out, word, values << low)
    np.add.at(out, word + 1, np.where(low > 0, values >> (np.uint64(64) - np.maximum(low, np.uint64(1))), np.uint64(0)))
    raw = out.astype("<u8").tobytes()
    return [raw[8 * b : 8 * b + (bits + 7) // 8] for b, bits in zip(begin.tolist(), at.tolist(), strict=True)]


def repeated_shares(images):
    """Of each image, the share of places whose two next pixels stood before: what copies can save at most."""
    flat = np.concatenate([image.ravel() for image in images])
    sizes = np.array([image.size for image in images])
    owner = np.repeat(np.arange(len(images)), sizes)
    key = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key[:-1] ^ (key[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + owner[:-1].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(flat), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(owner, weights=again, minlength=len(images)) / sizes


def as_webp(content):
    """A WebP file of a VP8L chunk's content."""
    padded = content + bytes(len(content) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(content).to_bytes(4, "little") + padded


def encode_webp(image, **tools):
    """A WebP file; see encode_vp8l."""
    return as_webp(encode_vp8l(image, **tools))
