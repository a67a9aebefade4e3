"""Kernels against plain definitions, and known vectors."""

from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringseq.functions import frames, kernels
from ringseq.functions.kernels import Monomerizer, canonicalize, find_orfs, lmsr, lmsr_index, longest_orfs, revcomp

dna = lambda a, b: st.text("ACGT", min_size=a, max_size=b).map(str.encode)


@given(st.one_of(st.binary(max_size=60), st.text("AB", max_size=40).map(str.encode), dna(0, 12).flatmap(lambda s: st.integers(1, 4).map(lambda k: s * k))))
def test_least_rotation(s):
    naive = min(range(len(s)), key=lambda i: (s[i:] + s[:i], i)) if s else 0
    assert lmsr_index(s) == naive
    assert kernels._least(s + s, len(s)) % max(1, len(s)) == naive or lmsr(s) == s[naive:] + s[:naive]
    assert lmsr(lmsr(s)) == lmsr(s)


def test_least_rotation_of_long_periods():
    s = b"AT" * 40000
    assert lmsr_index(s) == 0 and lmsr_index(s[1:] + s[:1]) == 1


@given(dna(1, 60), st.integers(0, 59))
def test_canonical_form_is_of_the_circle(s, k):
    k %= len(s)
    turned = s[k:] + s[:k]
    assert canonicalize(turned) == canonicalize(s) == canonicalize(revcomp(turned)) == canonicalize(canonicalize(s))


def test_known_rotations():
    assert [lmsr_index(x) for x in (b"AAA", b"banana", b"TAA")] == [0, 5, 1]
    assert [lmsr(x) for x in (b"AAA", b"banana", b"TAA")] == [b"AAA", b"abanan", b"AAT"]
    assert canonicalize(b"ATT") == b"AAT"


ORFS = [
    ("AAAATGCCCCCCCCCTAA", 3, 15, 0, 15), ("GCATAAGCAATG", 9, 3, 1, 9), ("AATGAAAAAAAAATA", 1, 13, 1, 15), ("GCATAAGATG", 7, 3, 1, 9),
    ("GCATAAGCATG", 8, 3, 1, 9), ("ATGAAAAAAAAATA", 0, 12, 1, 15), ("ATGAAAAAAAAAA", 0, 1, 2, 30), ("AATGCATAAAA", 1, 6, 2, 30),
    ("ACATACGCATG", 8, 9, 2, 15), ("AATGCAAAAAAATA", 1, 12, 3, 42), ("AAATGGCATACT", 2, 11, 1, 12), ("ATGGCATA", 0, 6, 1, 9),
    ("GGTCGGAGAATTGGGTCAGTTTCGGGCTTAAAAACTCTGACTTGTCATGCTCGTGGCGTCCCTACCG", 46, 28, 3, 186),
]


@pytest.mark.parametrize("seq,start,stop,wraps,length", ORFS)
def test_known_frames(seq, start, stop, wraps, length):
    assert find_orfs(seq.encode()).tolist() == [[start, stop, wraps, length]]


def test_longest_of_a_stop():
    assert longest_orfs(find_orfs(b"ATGATGTAG")).tolist() == [[0, 6, 0, 9]]
    assert find_orfs(b"").tolist() == find_orfs(b"A").tolist() == []


def walked(seq, starts, stops):
    """Frames by walking codon by codon."""
    n, ring = len(seq), seq * 5
    at = lambda i: ring[i % n : i % n + 3]
    out = []
    for s in (i for i in range(n) if at(i) in starts):
        for d in range(0, n if n % 3 == 0 else 3 * n, 3):
            t = (s + d) % n
            stop = at(t) in stops and (t >= n - 2 or at(t) not in starts)
            if stop and not (n % 3 == 0 and d == 0):
                out.append([s, t, (s + d + 2) // n, d + 3])
                break
        else:
            out.append([s, -1, 1 if n % 3 == 0 else 3, n if n % 3 == 0 else 3 * n])
    return out


# Sequences on which frames were once found wrong (fixed values).
REGRESSIONS = [
    "ATGGCGTACAGAGTACTAGTAGACCCGGCACGCTTGGTACCCGACAGTAAGAGCCTTGTATTGCGGTAAGTCTACAGCGGGTGGGGCCTAAAACATGGGTATGTGCGCTTGTGAGGGAATACCGAATAGATCTTCGTATCTGGGATGCGTTAATATAGACTTTAGCTCCGCTCAGGCCAGTGGGAAATATTAGCACCGGGCCCACCGCGGAACCGGTCTTTTGCGGACTGCTGAACCGCACACACTGTCTAATGA",
    "ATGAAGAACGTAAATTCTGGGCTTTTCTAGTTGTGATAATATATGGGGACGAGTGTACCTCTCGACGTAGATTAGTCGATCCACTAACAGACCTTGTGCGTTATGGGTCAAACAATATATGGGCGGACCCTGCCTGTTTAGGTTTCCCGATGA",
    "TGTCGGAGAATTGGGTCAGTTTCGGGCTTAAAAACTCTGACTTGTCATGCTCGTGGCGTCCCTA",
    "ATGTGCCCACATTCCATTCTCAGGCCTCCTCATGG",
    "",
    "TATAGGCAGTGTCCGTTCTGTTCTCCGACAGTATAACAAGACTCTTATATTTGAAAGGGCAGGTTCCCGACAACGTGGACTAGCGCGAGAATTTTGCCTAATCGTGATAGTAGGGATCGGCGTATGACACAACTGCGAGTGAAGCAATGAAGGTGAGTTTTGGTCTGCCAGCTGAATCAATCTCTATCAAACCTGTGCCACGCTA",
    "ATGAAACCATGTGAAGACTAAGAGGGGGGGATATGGAAACATCGACTGA",
    "AATGAGTT",
    "TTACTAAGTAAATGA",
    "GATGCGTCTGTTGATTCCTTTGCACACCTA",
    "ACTTGAATTTTGAATACGAGGCGCCTTCCGTGGAGCGGGCGTCCGTATAACGCTCCATCCCGGTCACTTATCGTGGTGGATTATGCGCTACCTAACTCATCTAGCTAGCACGACGGCAGTCTGCCCGGTAGCCAATGGCCTTAGCGCTCGATAGCTGCAGACGAGGGCTCCTGGTAAATCAATGCATATGGCTATAGAAACTTGCACTAAGTCGCCTTG",
    "CACTGAAGGGTACACAGGGAAGGTATCCCTACGTAGGGGATTTCACCACACCTATAGCATGATGCCGTGGCTTGCCTAG",
]


@pytest.mark.parametrize("seq", REGRESSIONS)
def test_frames_of_former_faults(seq):
    assert find_orfs(seq.encode()).tolist() == (walked(seq, ("ATG",), ("TAA", "TAG", "TGA")) if seq else [])


CODONS = [(("ATG",), ("TAA", "TAG", "TGA")), (("ATG", "TAA"), ("TAA", "TAG")), (("ATG", "CTG", "TTG"), ("TAA", "CTG", "atg", "TA"))]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text("ATG", max_size=30), st.text("ACGTN-", max_size=70), st.sampled_from(REGRESSIONS)), max_size=8),
    st.sampled_from(CODONS), st.booleans(), st.sampled_from([(-3, False, 0, 3, 0.0), (6, True, 0, 0, 0.0), (0, False, 1, 3, 0.5)]), st.sampled_from([10, 1 << 20]),
)
def test_frames_of_a_batch(seqs, codons, longest, limits, bases):
    """Both strands of all sequences at once give what the kernel gives for each."""
    import pyarrow as pa

    least, stop, low, high, ratio = limits
    table = pa.array(["ATG", *seqs], pa.string()).slice(1)
    with mock.patch.object(frames, "BASES", bases):
        got = frames.frames(table, *codons, strands="+-", longest=longest, min_length=least, stop_required=stop, min_wraps=low, max_wraps=high, min_ratio=ratio).to_pylist()
        places = frames.places(table, *codons).to_pylist()
    assert len(got) == len(places) == len(seqs)
    for seq, own, place in zip(seqs, got, places):
        want = []
        for back in (False, True):
            s = revcomp((seq or "").encode()) if back else (seq or "").encode()
            o = find_orfs(s, *codons)
            keep = (o[:, 3] - 3 >= least) & (o[:, 2] >= low) & (o[:, 2] <= high) & (o[:, 3] >= ratio * len(s)) & ((o[:, 1] >= 0) | (not stop))
            want += [(back, a, None if b < 0 else b, w, n) for a, b, w, n in (longest_orfs(o[keep]) if longest else o[keep]).tolist()]
        assert sorted(str(tuple(x.values())) for x in own) == sorted(map(str, want))
        assert [place["starts"], place["stops"]] == [x.tolist() for x in kernels.codon_positions((seq or "").encode(), *codons)]


@settings(max_examples=300)
@given(st.text("ATGC", min_size=3, max_size=40), st.sampled_from([(("ATG",), ("TAA", "TAG", "TGA")), (("ATG", "TAA"), ("TAA", "TAG")), (("ATG", "CTG", "TTG"), ("TAA", "atg", "TA"))]))
def test_frames_as_walked(seq, codons):
    found = find_orfs(seq.encode(), *codons)
    assert found.tolist() == walked(seq, *codons)
    assert all(n % 3 == 0 for _, stop, _, n in found.tolist() if stop >= 0)
    best = longest_orfs(found).tolist()
    assert {tuple(x) for x in best} <= {tuple(x) for x in found.tolist()}
    assert sorted(s for _, s, _, _ in best) == sorted(set(found[:, 1].tolist()))


@pytest.mark.parametrize("seq,config,kept", [
    ("ATGCATGC", (2, 0), 4), ("ATGCATGC", (4, 1), 4), ("AAAAATTTTTAAAAATTTTT", (10, 0), 10), ("TTTTTTTTTTTTAAAAAAAAAA", (4, 0), 22), ("TTTTTTTTTTTTAAAAAAAAAA", (10, 2), 22),
    ("AAAAATTTTT" * 3, (4, 2), 10), ("AACAATTTTTAAGAATTTTTAAAAATTTTT", (4, 3), 10), ("TGCCAATGCATGCCAATGC", (4, 0), 10), ("ATGACAGGTACAGCATA" * 2, (6, 0), 17), ("ATGACAGGTACAGCATA" * 2, (11, 3), 17),
])
def test_known_monomers(seq, config, kept):
    assert len(Monomerizer(*config).slice(seq.encode())) == kept


def test_sensitive_and_validation():
    s = b"ATGCCCATGCGCCAGCGCAAATGCCCATGCGCCAGCGCAG"
    assert Monomerizer(4, min_identity=0.95).end_sensitive(s) == 20
    for bad in ({"seed_length": 0}, {"seed_length": 64}, {"max_mismatch": 1, "min_identity": 0.5}, {"min_identity": 1.5}, {"max_mismatch": -1}):
        with pytest.raises(ValueError):
            Monomerizer(**bad)


@given(dna(20, 100))
def test_trimers_collapse(s):
    assert len(Monomerizer(10, 0).slice(s * 3)) <= len(s)


@given(dna(0, 70), st.integers(1, 12), st.integers(0, 3))
def test_first_end_by_definition(s, k, d):
    s = s + s[: len(s) // 2]
    n, want = len(s), None
    for m in range(k, n - k + 1):
        if s[m - k : m] == s[n - k :] and sum(a != b for a, b in zip(s[:m], s[n - m :])) <= d:
            want = n - m
            break
    assert Monomerizer(k, d).first_end(s) == want
