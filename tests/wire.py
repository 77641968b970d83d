"""Straight-line builders and parsers the library is checked against."""

import struct


def crc(data):
    value = 0
    for byte in data:
        for bit in range(8):
            mix = (value ^ (byte >> bit)) & 1
            value >>= 1
            if mix:
                value ^= 0xA6BC
    return struct.pack("<H", value ^ 0xFFFF)


def frame(ctrl, src, dst, user=b""):
    head = struct.pack("<2sBBHH", b"\x05\x64", 5 + len(user), ctrl, dst, src)
    parts = [head, crc(head)]
    for i in range(0, len(user), 16):
        parts += [user[i:i + 16], crc(user[i:i + 16])]
    return b"".join(parts)


def parse(buf):
    """(pos, ctrl, src, dst, fc, user_data_len, wire_size) of each frame."""
    out, at = [], buf.find(b"\x05\x64")
    while at >= 0 and at + 10 <= len(buf):
        length, ctrl, dst, src = struct.unpack_from("<BBHH", buf, at + 2)
        user = length - 5 if length > 5 else 0
        size = 10 + user + 2 * -(-user // 16)
        if at + size > len(buf):
            break
        out.append((at, ctrl, src, dst, buf[at + 12] if user > 2 else None, user, size))
        at = buf.find(b"\x05\x64", at + size)
    return out


def tcp(src, sport, dst, dport, payload=b"", flags=24, win=512, pad=b"", link="eth", options=b""):
    ip4 = lambda a: bytes(int(x) for x in a.split("."))
    offset = (20 + len(options)) // 4
    body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, offset << 4, flags, win, 0, 0) + options + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, ip4(src), ip4(dst)) + body
    head = {
        "eth": b"\0" * 12 + b"\x08\x00", "vlan": b"\0" * 12 + b"\x81\x00\x00\x01\x08\x00",
        "null": struct.pack("<I", 2), "raw": b"", "sll": b"\0" * 14 + b"\x08\x00",
    }[link]
    return head + ip + pad


def pcap(records, link=1, order="<", magic=0xA1B2C3D4):
    out = [struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)]
    for ts_us, data in records:
        out += [struct.pack(order + "IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(data), len(data)), data]
    return b"".join(out)
