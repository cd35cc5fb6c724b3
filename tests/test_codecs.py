import numpy as np
import pytest

from tessera.errors import Unsupported
from tessera.operators import codecs as C
from tessera.operators import jpeg, jpegls


def smooth(rows, columns, samples, seed=0):
    y, x = np.mgrid[:rows, :columns]
    a = np.stack([127 + 100 * np.sin(x / 9 + k) * np.cos(y / 7 - k) for k in range(samples)], axis=-1) + np.random.default_rng(seed).normal(0, 2, (rows, columns, samples))
    a = np.clip(a, 0, 255).astype(np.uint8)
    return a[..., 0] if samples == 1 else a


@pytest.mark.parametrize("samples", [1, 3])
@pytest.mark.parametrize("shape", [(8, 8), (16, 24), (37, 61)])
@pytest.mark.parametrize("halved", [(1, 1), (1, 2), (2, 2)])
def test_baseline(shape, samples, halved):
    a = smooth(*shape, samples)
    errors = [np.abs(jpeg.decode(jpeg.encode(a, q, halved)).astype(int) - a).mean() for q in (100, 90, 30)]
    assert errors[0] < (1 if samples == 1 or halved == (1, 1) else 8) and errors[0] <= errors[1] <= errors[2]


def test_baseline_of_extremes():
    for a in (np.zeros((9, 9), np.uint8), np.full((16, 16, 3), 255, np.uint8), np.random.default_rng(1).integers(0, 256, (40, 40, 3)).astype(np.uint8)):
        assert np.abs(jpeg.decode(jpeg.encode(a, 100)).astype(int) - a).max() <= 4
    same = smooth(16, 16, 3)
    assert np.abs(jpeg.decode(jpeg.encode(same, 100, colour=False), rgb=False).astype(int) - same).max() <= 2


@pytest.mark.parametrize("codec", [(jpeg.encode_lossless, jpeg.decode), (jpegls.encode, jpegls.decode)])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (32, 48), (9, 16, 3)])
def test_lossless(codec, dtype, shape):
    r, top = np.random.default_rng(2), np.iinfo(dtype).max
    for a in (r.integers(0, top + 1, shape), np.zeros(shape), np.full(shape, top), r.integers(0, 2, shape), np.cumsum(r.integers(0, 2, shape), axis=1) % (top + 1), np.repeat(r.integers(0, top, (shape[0], 1, *shape[2:])), shape[1], axis=1)):
        a = a.astype(dtype)
        assert np.array_equal(codec[1](codec[0](a)), a)


@pytest.mark.parametrize("near", [1, 3, 10])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_near_lossless(near, dtype):
    r, top = np.random.default_rng(8), np.iinfo(dtype).max
    for a in (r.integers(0, top + 1, (20, 33)), np.full((9, 9), top), 100 + r.integers(0, 9, (16, 40, 3)), np.cumsum(r.integers(0, 2, (12, 50)), axis=1)):
        a = a.astype(dtype)
        data = jpegls.encode(a, near=near)
        assert np.abs(jpegls.decode(data).astype(int) - a).max() <= near
    assert len(jpegls.encode(smooth(64, 64, 1), near=near)) < len(jpegls.encode(smooth(64, 64, 1)))


def test_jpeg_ls_example_of_the_standard():
    a = np.array([[0, 0, 90, 74], [68, 50, 43, 205], [64, 145, 145, 145], [100, 145, 145, 145]], np.uint8)
    assert jpegls.encode(a).hex() == "ffd8fff7000b080004000401011100ffda0008010100000000c000006c80208e01c00000574000006ee6000001bc18000005d800009160ffd9"


def test_extended_of_12_bits():
    y, x = np.mgrid[:37, :45]
    a = np.clip(2047 + 1900 * np.sin(x / 9) * np.cos(y / 7) + np.random.default_rng(7).normal(0, 9, x.shape), 0, 4095).astype(np.uint16)
    data = C.encode_frame(a, C.JPEG_EXTENDED, quality=100)
    assert np.abs(C.decode_frame(data, C.JPEG_EXTENDED, 37, 45, 1, 12).astype(int) - a).max() <= 3
    with pytest.raises(Unsupported):
        jpeg.encode(np.full((8, 8), 5000, np.uint16))
    with pytest.raises(Unsupported):
        C.encode_frame(a, C.JPEG_BASELINE)
    assert C.decoder(C.JPEG_EXTENDED, 1, 12) and C.decoder(C.JPEG_EXTENDED, 3, 12) is None and C.decoder(C.JPEG_EXTENDED, 1, 16) is None


def test_restart_intervals():
    """A stretch that starts anew after every unit decodes like one that doesn't."""
    a = smooth(16, 24, 1)
    whole = jpeg.encode(a, 100)
    scan = whole.index(b"\xff\xda")
    head, bits = whole[: scan + 10], jpeg._Bits(whole[scan + 10 :])
    assert len(bits.parts) == 1 and head[-3:] == b"\0\x3f\0"
    marked = jpeg._Bits(b"ab\xff\xd0cd\xff\0\xff\xd1ef\xff\xd9")
    assert marked.parts == [b"ab", b"cd\xff", b"ef"]


@pytest.mark.parametrize("counts", [{0: 1}, {0: 5, 1: 1}, {k: 2**k for k in range(30)}, {k: 1 for k in range(200)}])
def test_code_lengths(counts):
    lengths = jpeg.code_lengths(counts)
    assert set(lengths) == set(counts) and max(lengths.values()) <= 16
    assert sum(2.0**-n for n in lengths.values()) < 1  # the code of ones stays free
    assert all(lengths[a] <= lengths[b] for a in counts for b in counts if counts[a] > counts[b])


@pytest.mark.parametrize("syntax", [C.EXPLICIT, C.IMPLICIT, C.BIG_ENDIAN, C.RLE, C.JPEG_LOSSLESS_FIRST, C.JPEG_LS])
@pytest.mark.parametrize(("samples", "bits"), [(1, 8), (3, 8), (1, 16)])
def test_frames_come_back(syntax, samples, bits):
    a = smooth(12, 20, samples) if bits == 8 else np.random.default_rng(4).integers(0, 65536, (12, 20)).astype(np.uint16)
    assert np.array_equal(C.decode_frame(C.encode_frame(a, syntax), syntax, 12, 20, samples, bits, "RGB" if samples == 3 else "MONOCHROME2"), a)


def test_what_cannot_be_read():
    with pytest.raises(Unsupported):
        C.decode_frame(b"", C.JPEG_2000, 8, 8)
    with pytest.raises(Unsupported):
        C.encode_frame(np.zeros((8, 8), np.uint8), C.JPEG_XL)
    with pytest.raises(Unsupported):
        C.decode_frame(jpeg.encode(np.zeros((8, 8), np.uint8)), C.JPEG_BASELINE, 16, 16)
    with pytest.raises(Unsupported):
        jpeg.decode(b"\xff\xd8\xff\xc9\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0")
    assert C.decoder(C.JPEG_BASELINE, 3, 16) is None and C.decoder(C.RLE, 3, 16) is not None
