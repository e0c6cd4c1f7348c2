"""PNG images, uncompressed DICOM files and PDFs of page images, read and written
with the standard library and numpy."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# PNG

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: np.ndarray) -> bytes:
    """Grey (h, w) or colour (h, w, 2 to 4) of 8 or 16 bits, without loss."""
    p = np.ascontiguousarray(pixels, ">u2" if pixels.dtype.itemsize == 2 else np.uint8)
    h, w = p.shape[:2]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[p.shape[2] if p.ndim == 3 else 1]
    raw = p.view(np.uint8).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8 * p.dtype.itemsize, kind, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    """Lines without their filters; `step` bytes a pixel."""
    lines, out = raw.reshape(h, stride + 1), np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            now = line
        elif kind == 1:  # sums along the line, a byte of the pixel at a time
            now = np.concatenate([np.cumsum(line[k::step], dtype=np.uint8)[:, None] for k in range(step)], 1).ravel() if stride % step == 0 else line
        elif kind == 2:
            now = line + above
        else:
            now, left, corner = np.zeros(stride, np.int64), [0] * step, [0] * step
            for k in range(stride):
                a, b, c, j = left[k % step], int(above[k]), corner[k % step], k % step
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    to = a + b - c
                    guess = min((abs(to - a), 0, a), (abs(to - b), 1, b), (abs(to - c), 2, c))[2]
                now[k] = left[j] = (int(line[k]) + guess) & 255
                corner[j] = b
            now = now.astype(np.uint8)
        out[y] = above = now
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels as write_png() takes them; palettes become colours. Interlaced
    images are refused."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += n + 12
    if head is None:
        raise ValueError("a PNG image without a header")
    w, h, depth, kind, _, _, interlaced = head
    if interlaced:
        raise NotImplementedError("interlaced PNG images")
    c = _CHANNELS[kind]
    stride = (w * c * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    lines = _unfiltered(raw, h, stride, max(1, c * depth // 8))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, : w * c]
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        if kind == 0:
            lines = lines * np.uint8(255 // ((1 << depth) - 1))
    px = lines.view(">u2").astype(np.uint16) if depth == 16 else lines
    px = px.reshape(h, w, c)
    if kind == 3:
        return palette[px[:, :, 0]]
    return px[:, :, 0] if c == 1 else px


# DICOM

IMPLICIT, EXPLICIT, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
_LONG = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
_NUMBER = {"US": "H", "UL": "I", "SS": "h", "SL": "i", "FL": "f", "FD": "d"}
#: Representations whose values are not told as text.
_BYTES = _LONG - {"UT"}
#: Keyword and value representation of the tags that are read or changed.
TAGS: dict[int, tuple[str, str]] = {}
for _line in """
00080012 InstanceCreationDate DA|00080016 SOPClassUID UI|00080018 SOPInstanceUID UI|00080020 StudyDate DA|00080021 SeriesDate DA|00080022 AcquisitionDate DA|00080023 ContentDate DA
00080050 AccessionNumber SH|00080060 Modality CS|00080080 InstitutionName LO|00080081 InstitutionAddress ST|00080090 ReferringPhysicianName PN|00080092 ReferringPhysicianAddress ST
00080094 ReferringPhysicianTelephoneNumbers SH|00081010 StationName SH|00081030 StudyDescription LO|0008103E SeriesDescription LO|00081040 InstitutionalDepartmentName LO
00081048 PhysiciansOfRecord PN|00081050 PerformingPhysicianName PN|00081060 NameOfPhysiciansReadingStudy PN|00081070 OperatorsName PN|00081080 AdmittingDiagnosesDescription LO
00100010 PatientName PN|00100020 PatientID LO|00100030 PatientBirthDate DA|00100032 PatientBirthTime TM|00100040 PatientSex CS|00101000 OtherPatientIDs LO|00101001 OtherPatientNames PN
00101002 OtherPatientIDsSequence SQ|00101005 PatientBirthName PN|00101010 PatientAge AS|00101040 PatientAddress LO|00101060 PatientMotherBirthName PN|00101090 MedicalRecordLocator LO
00102154 PatientTelephoneNumbers SH|001021B0 AdditionalPatientHistory LT|00102297 ResponsiblePerson PN|00102299 ResponsibleOrganization LO|00104000 PatientComments LT
00120021 ClinicalTrialProtocolName LO|00120031 ClinicalTrialSiteName LO|0020000D StudyInstanceUID UI|0020000E SeriesInstanceUID UI|00204000 ImageComments LT
00280002 SamplesPerPixel US|00280004 PhotometricInterpretation CS|00280006 PlanarConfiguration US|00280008 NumberOfFrames IS|00280010 Rows US|00280011 Columns US
00280100 BitsAllocated US|00280101 BitsStored US|00280102 HighBit US|00280103 PixelRepresentation US|00321060 RequestedProcedureDescription LO
00400244 PerformedProcedureStepStartDate DA|00400250 PerformedProcedureStepEndDate DA|00400254 PerformedProcedureStepDescription LO|00401002 ReasonForTheRequestedProcedure LO|7FE00010 PixelData OW
""".strip().replace("\n", "|").split("|"):  # fmt: skip
    _tag, _word, _vr = _line.split()
    TAGS[int(_tag, 16)] = (_word, _vr)
NUMBER_OF = {w: t for t, (w, _) in TAGS.items()}
_SIZES = {NUMBER_OF["Rows"], NUMBER_OF["Columns"]}


@dataclass
class Dicom:
    """Elements in their order, (tag, value representation, bytes), and the
    syntax they were read in. Sequences keep their bytes."""

    elements: list[tuple[int, str, bytes]]
    syntax: str

    def tags(self) -> dict[str, str]:
        """The values of known tags as text; sequences and pixels left out."""
        return {TAGS[t][0]: self._text(vr, v) for t, vr, v in self.elements if t in TAGS and vr not in _BYTES}

    def _text(self, vr: str, v: bytes) -> str:
        if vr in _NUMBER:
            end = ">" if self.syntax == BIG else "<"
            n = struct.calcsize(_NUMBER[vr])
            return "\\".join(str(x) for x in struct.unpack(f"{end}{len(v) // n}{_NUMBER[vr]}", v[: len(v) // n * n]))
        return v.decode("utf-8", "replace").rstrip("\0 ")

    def dump(self) -> str:
        """One line an element: tag, representation, keyword and value."""
        lines = []
        for t, vr, v in self.elements:
            word = TAGS.get(t, ("", ""))[0]
            lines.append(f"({t >> 16:04X},{t & 0xFFFF:04X}) {vr} {word}: {f'{len(v)} bytes' if vr in _BYTES else self._text(vr, v)}")
        return "\n".join(lines)

    def shape(self) -> tuple[int, ...]:
        """Axes of the pixels: frames if there are several, rows, columns, colours."""
        return self._shape(self.tags())

    @staticmethod
    def _shape(t: dict[str, str]) -> tuple[int, ...]:
        frames, colours = int(t.get("NumberOfFrames") or 1), int(t.get("SamplesPerPixel") or 1)
        return (*([frames] if frames > 1 else []), int(t["Rows"]), int(t["Columns"]), *([colours] if colours > 1 else []))

    def pixels(self) -> np.ndarray:
        t, data = self.tags(), next((v for k, _, v in self.elements if k == NUMBER_OF["PixelData"]), None)
        if data is None:
            raise ValueError("no pixels")
        kind = f"{'>' if self.syntax == BIG else '<'}{'i' if t.get('PixelRepresentation') == '1' else 'u'}{int(t['BitsAllocated']) // 8}"
        shape = self._shape(t)
        p = np.frombuffer(data, kind)[: int(np.prod(shape))]
        if t.get("PlanarConfiguration") == "1" and int(t.get("SamplesPerPixel") or 1) > 1:
            return np.moveaxis(p.reshape(*shape[:-3], shape[-1], *shape[-3:-1]), -3, -1)
        return p.reshape(shape)

    def rewritten(self, tags: dict[str, str], pixels: np.ndarray | None = None, note: str = "") -> Dicom:
        """With the given values in place of old ones, and the pixels at their
        full depth; a note is added to ImageComments."""
        out, big = [], self.syntax == BIG
        for t, vr, v in self.elements:
            word = TAGS.get(t, (None,))[0]
            if t == NUMBER_OF["PixelData"] and pixels is not None:
                own = self.tags()
                planar = own.get("PlanarConfiguration") == "1" and int(own.get("SamplesPerPixel") or 1) > 1
                v = (np.moveaxis(pixels, -1, -3) if planar else pixels).astype(np.frombuffer(b"", self.pixels().dtype).dtype).tobytes()
            elif word in tags and vr not in _NUMBER:
                text = tags[word] if vr != "SQ" else ""
                v = text.encode() if vr != "SQ" or tags[word] == "" else v
            out.append((t, vr, v))
        if note:
            at = NUMBER_OF["ImageComments"]
            old = next((self._text(vr, v) for t, vr, v in out if t == at), "")
            out = sorted([x for x in out if x[0] != at] + [(at, "LT", f"{old} {note}".strip().encode())], key=lambda x: x[0])
        return Dicom(out, BIG if big else self.syntax)


def _elements(data: bytes, at: int, explicit: bool, end: str, stop: int | None = None) -> tuple[list[tuple[int, str, bytes]], int]:
    """Elements from `at` on, up to `stop` or a delimiter of the sequence they lie in."""
    out, stop = [], len(data) if stop is None else stop
    while at + 8 <= stop:
        g, e = struct.unpack_from(f"{end}HH", data, at)
        tag, vr = g << 16 | e, "UN"
        if g == 0xFFFE:
            if e in (0xE00D, 0xE0DD):
                return out, at + 8
            n, at = struct.unpack_from(f"{end}I", data, at + 4)[0], at + 8
        elif explicit:
            vr = data[at + 4 : at + 6].decode("ascii")
            if not (vr.isupper() and vr.isalpha()):
                raise ValueError("no value representation")
            n, at = (struct.unpack_from(f"{end}I", data, at + 8)[0], at + 12) if vr in _LONG else (struct.unpack_from(f"{end}H", data, at + 6)[0], at + 8)
        else:
            n, at = struct.unpack_from(f"{end}I", data, at + 4)[0], at + 8
            vr = TAGS.get(tag, ("", "UN"))[1]
        if n == 0xFFFFFFFF:
            if tag == NUMBER_OF["PixelData"]:
                raise NotImplementedError("compressed pixels")
            begin = at
            at = _elements(data, at, explicit and vr != "UN", end)[1] if g == 0xFFFE else _items(data, at, explicit, end)
            out.append((tag, vr, data[begin:at]))
            continue
        if at + n > stop:
            raise ValueError("an element longer than the file")
        out.append((tag, vr, data[at : at + n]))
        at += n
    return out, at


def _items(data: bytes, at: int, explicit: bool, end: str) -> int:
    """The end of a sequence without a length."""
    while at + 8 <= len(data):
        g, e, n = struct.unpack_from(f"{end}HHI", data, at)
        at += 8
        if (g, e) == (0xFFFE, 0xE0DD):
            return at
        at = _elements(data, at, explicit, end)[1] if n == 0xFFFFFFFF else at + n
    raise ValueError("a sequence without an end")


def read_dicom(data: bytes) -> Dicom:
    """A file in its own syntax; where that is missing or wrong, in the first of
    three that gives elements with rows and columns."""
    at, named = (132, None) if data[128:132] == b"DICM" else (0, None)
    if at:
        meta, body = [], at
        while body + 8 <= len(data) and data[body : body + 2] == b"\x02\x00":
            one, body = _elements(data, body, True, "<", body + 8 + (4 if data[body + 4 : body + 6].decode("latin1") in _LONG else 0) + _length(data, body))
            meta += one
        named = next((v.rstrip(b"\0 ").decode() for t, _, v in meta if t == 0x00020010), None)
        at = body
    if named not in (None, IMPLICIT, EXPLICIT, BIG):
        raise NotImplementedError(f"transfer syntax {named}")
    failed: Exception = ValueError("not a DICOM file")
    for s in dict.fromkeys([named or EXPLICIT, EXPLICIT, IMPLICIT, BIG]):
        try:
            d = Dicom(_elements(data, at, s != IMPLICIT, ">" if s == BIG else "<")[0], s)
            if d.elements and all(a[0] < b[0] for a, b in zip(d.elements, d.elements[1:])) and _SIZES <= {t for t, vr, _ in d.elements if vr not in _BYTES}:
                return d
        except NotImplementedError:
            raise
        except (ValueError, struct.error, UnicodeDecodeError) as e:
            failed = e
    raise ValueError(f"no known syntax fits: {failed}")


def _length(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at + 8)[0] if data[at + 4 : at + 6].decode("latin1") in _LONG else struct.unpack_from("<H", data, at + 6)[0]


def write_dicom(d: Dicom) -> bytes:
    """The elements in their syntax, behind a preamble and meta data."""

    def element(t: int, vr: str, v: bytes, explicit: bool, end: str) -> bytes:
        v += b"" if len(v) % 2 == 0 else b"\0" if vr in ("UI", "OB", "UN") else b" "
        head = struct.pack(f"{end}HH", t >> 16, t & 0xFFFF)
        if not explicit:
            return head + struct.pack(f"{end}I", len(v)) + v
        return head + vr.encode() + (struct.pack(f"{end}HI", 0, len(v)) if vr in _LONG else struct.pack(f"{end}H", len(v))) + v

    # What had no length gets one; the delimiter at its end goes with it.
    body = b"".join(element(t, vr, v[:-8] if vr == "SQ" and v[-8:-4] in (b"\xfe\xff\xdd\xe0", b"\xff\xfe\xe0\xdd") else v, d.syntax != IMPLICIT, ">" if d.syntax == BIG else "<") for t, vr, v in d.elements)
    uid = next((v for t, _, v in d.elements if t == NUMBER_OF["SOPInstanceUID"]), b"")
    kind = next((v for t, _, v in d.elements if t == NUMBER_OF["SOPClassUID"]), b"")
    meta = b"".join(element(t, vr, v, True, "<") for t, vr, v in ((0x00020001, "OB", b"\0\1"), (0x00020002, "UI", kind), (0x00020003, "UI", uid), (0x00020010, "UI", d.syntax.encode())))
    return b"\0" * 128 + b"DICM" + element(0x00020000, "UL", struct.pack("<I", len(meta)), True, "<") + meta + body


def new_dicom(pixels: np.ndarray, tags: dict[str, str], syntax: str = EXPLICIT) -> Dicom:
    """A file of pixels, grey or colour, of one frame or several."""
    end = ">" if syntax == BIG else "<"
    colour = pixels.ndim >= 3 and pixels.shape[-1] == 3
    frames = pixels.shape[0] if pixels.ndim == 3 + colour else 1
    rows, cols = pixels.shape[-3:-1] if colour else pixels.shape[-2:]
    bits = 8 * pixels.dtype.itemsize
    own = {
        "SamplesPerPixel": 3 if colour else 1, "PhotometricInterpretation": "RGB" if colour else "MONOCHROME2", "NumberOfFrames": frames, "Rows": rows, "Columns": cols, "BitsAllocated": bits,
        "BitsStored": bits, "HighBit": bits - 1, "PixelRepresentation": int(pixels.dtype.kind == "i"), **tags,
    }
    out = []
    for word, v in own.items():
        vr = TAGS[NUMBER_OF[word]][1]
        out.append((NUMBER_OF[word], vr, struct.pack(f"{end}{_NUMBER[vr]}", int(v)) if vr in _NUMBER else str(v).encode()))
    out.append((NUMBER_OF["PixelData"], "OW", pixels.astype(f"{end}{pixels.dtype.kind}{pixels.dtype.itemsize}").tobytes()))
    return Dicom(sorted(out, key=lambda x: x[0]), syntax)


# PDF


def write_pdf(pages: list[np.ndarray], dpi: int = 300) -> bytes:
    """One page an image, 8-bit grey or RGB, at its size under `dpi`."""
    n, objects = len(pages), []
    kids = " ".join(f"{3 + 3 * k} 0 R" for k in range(n))
    objects += [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode()]
    for k, p in enumerate(pages):
        h, w = p.shape[:2]
        wide, high = w * 72 / dpi, h * 72 / dpi
        data, paint = zlib.compress(np.ascontiguousarray(p[..., :3] if p.ndim == 3 else p, np.uint8).tobytes()), f"q {wide:.3f} 0 0 {high:.3f} 0 0 cm /I Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {wide:.3f} {high:.3f}] /Contents {4 + 3 * k} 0 R /Resources << /XObject << /I {5 + 3 * k} 0 R >> >> >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(paint), paint))
        space = "DeviceGray" if p.ndim == 2 else "DeviceRGB"
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8 /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
