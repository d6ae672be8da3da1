import random

import pytest

from tilefold.functions import codecs

SMALL = bytes([4, 4, 0, 1, 2, 3, 3, 3, 6, 6, 6, 6, 1])
RUNS = bytes([0] * 300 + [5] * 130 + [1, 2, 3] + [7] * 127 + [9, 9, 0])


# Streams that the console decoders define for these bytes.
@pytest.mark.parametrize(
    ("codec", "data", "expected"),
    [
        ("rle", SMALL, "050404000102fd03fc06010100"),
        ("rle", RUNS, "81008100d2008105fd050301020381070309090000"),
        ("gb", SMALL, "c4040400010202030306c00100"),
        ("gb", RUNS, "7f00007f0000ab00ff7f0505c405050102033f07bec0ffc209090000"),
        ("pb8", SMALL, "430400010203770601"),
        ("pb16", SMALL, "010404000102030337060601"),
    ],
)
def test_known_bytes(codec, data, expected):
    assert codecs.CODECS[codec](data).hex() == expected


def noise(n):
    rng = random.Random(5)
    return bytes(rng.randrange(256) for _ in range(n))


@pytest.mark.parametrize("data", [SMALL, RUNS, b"\7", noise(400), bytes(700), b"abcabcabd" * 9])
def test_round_trips(data):
    assert codecs.un_zx0(codecs.zx0(data)) == data
    assert codecs.un_lz_gb(codecs.lz_gb(data)) == data


def test_zx0_is_short():
    assert len(codecs.zx0(RUNS)) < 25
    with pytest.raises(ValueError):
        codecs.zx0(b"")


def test_column(spark):
    df = spark.createDataFrame([(bytearray(SMALL),), (None,)], "x binary")
    assert [r[0] and r[0].hex() for r in df.select(codecs.encode_column(df.x, "rle")).collect()] == ["050404000102fd03fc06010100", None]


def least_bits(data, window):
    """Every parse by states (done, last offset, literals last), without any shortcut."""
    n, gamma = len(data), lambda v: 2 * v.bit_length() - 1
    best = {(0, 1, False): 0}
    for i in range(n):
        for (at, offset, literal), cost in sorted(best.items(), key=lambda s: s[0]):
            if at != i:
                continue
            moves = []
            if not literal:
                moves += [((i + k, offset, True), (1 if i else 0) + gamma(k) + 8 * k) for k in range(1, n - i + 1)]
            for o in range(1, min(i, window) + 1):
                k = 0
                while i + k < n and data[i + k] == data[i + k - o]:
                    k += 1
                    if literal and o == offset:
                        moves.append(((i + k, o, False), 1 + gamma(k)))
                    if k > 1:
                        moves.append(((i + k, o, False), 8 + gamma((o - 1) // 128 + 1) + gamma(k - 1)))
            for state, price in moves:
                best[state] = min(best.get(state, cost + price), cost + price)
    return min(c for (at, *_), c in best.items() if at == n)


def test_zx0_is_the_shortest():
    rng = random.Random(2)
    shapes = [bytes(rng.randrange(k) for _ in range(rng.randrange(1, 34))) for k in (1, 2, 2, 3, 4, 9) for _ in range(12)]
    # a lone byte that repeats inside long literals: passing over it is cheaper than using it
    shapes += [bytes([1, 2]) + bytes(range(10, 10 + k)) + bytes([1]) + bytes(range(40, 40 + k)) + bytes([1, 2, 9, 9]) for k in (3, 8, 17)]
    for data in shapes:
        bits, steps = codecs.zx0_steps(data)
        assert bits == least_bits(data, codecs.ZX0_WINDOW) and sum(s[3] for s in steps) == len(data)
        assert codecs.un_zx0(codecs.zx0(data)) == data
    far = bytes(rng.randrange(3) for _ in range(40))
    assert codecs.zx0_steps(far, 5)[0] == least_bits(far, 5)


def test_zx0_of_long_streams():
    rng = random.Random(3)
    for data in (bytes(5000), bytes(rng.randrange(2) for _ in range(1500)), b"".join(rng.choice([b"tile", b"map", b"\x00" * 9]) for _ in range(700)), bytes(rng.randrange(256) for _ in range(700))):
        packed = codecs.zx0(data)
        assert codecs.un_zx0(packed) == data and len(packed) <= len(data) * 1.01 + 8
