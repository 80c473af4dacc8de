"""XMP packets, SVG texts: reading by expat without external entities, filtering by namespace."""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.parsers import expat

from . import Malformed

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
# Namespaces of the two container vocabularies.
CONTAINERS = {
    "http://ns.google.com/photos/1.0/container/": "http://ns.google.com/photos/1.0/container/item/",
    "http://ns.google.com/photos/dd/1.0/container/": "http://ns.google.com/photos/dd/1.0/item/",
}


def _parser() -> expat.XMLParserType:
    p = expat.ParserCreate(namespace_separator="\n")
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def refuse(*_):
        raise Malformed("entity declared")

    p.EntityDeclHandler = refuse
    p.ExternalEntityRefHandler = lambda *_: 0
    return p


def _split(name: str) -> tuple[str, str]:
    ns, _, local = name.rpartition("\n")
    return ns, local


def _run(p: expat.XMLParserType, data: bytes) -> None:
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise Malformed(f"XML: {expat.errors.messages[e.code]}") from None


class Field(NamedTuple):
    ns: str
    name: str
    text: str
    leaves: list[str]


def packet(data: bytes) -> bytes:
    """The packet without processing instructions around it and zero padding after it."""
    data = data.rstrip(b"\0")
    a, b = data.find(b"<x:xmpmeta"), data.rfind(b"</x:xmpmeta>")
    return data[a : b + 12] if 0 <= a < b else data


def fields(data: bytes) -> list[Field]:
    """Top-level properties: attributes and children of rdf:Description, each with its texts joined."""
    out: list[Field] = []
    stack: list[tuple[str, str]] = []
    state: dict = {}

    def start(name, attrs):
        own = _split(name)
        if own == (RDF, "Description") and (not stack or stack[-1] == (RDF, "RDF")):
            out.extend(Field(*_split(k), v, [v]) for k, v in attrs.items() if _split(k)[0] not in ("", RDF, "http://www.w3.org/XML/1998/namespace"))
        elif len(stack) >= 1 and stack[-1] == (RDF, "Description") and "at" not in state:
            state.update(at=len(stack), key=own, leaves=[])
            state["leaves"] += [v for k, v in attrs.items() if k == f"{RDF}\nresource"]
        elif "at" in state:
            state["leaves"] += [v for k, v in attrs.items() if _split(k)[0] not in (RDF, "http://www.w3.org/XML/1998/namespace")]
        stack.append(own)
        state["text"] = ""

    def end(_):
        if "at" in state:
            if state.get("text", "").strip():
                state["leaves"].append(state["text"].strip())
            state["text"] = ""
            if len(stack) - 1 == state["at"]:
                out.append(Field(*state["key"], "|".join(state["leaves"]), state["leaves"]))
                del state["at"]
        stack.pop()

    def chars(t):
        state["text"] = state.get("text", "") + t

    p = _parser()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    _run(p, packet(data))
    return out


def filtered(data: bytes, keep) -> bytes:
    """The packet with only the top-level properties that keep(ns, name) allows: rdf:about blank, no comments, no space between elements. Empty if none stays."""
    out: list[str] = []
    skip = [0]
    stack: list[tuple[str, str]] = []
    used: dict[str, str] = {}
    kept = [0]
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def qname(key: tuple[str, str]) -> str:
        ns, local = key
        if not ns:
            return local
        if ns == "http://www.w3.org/XML/1998/namespace":
            return f"xml:{local}"
        return f"{used.setdefault(ns, 'rdf' if ns == RDF else 'x' if ns == 'adobe:ns:meta/' else f'n{len(used)}')}:{local}"

    def start(name, attrs):
        own = _split(name)
        top = bool(stack) and stack[-1] == (RDF, "Description") and sum(s == (RDF, "Description") for s in stack) == 1
        if skip[0] or top and not keep(*own):
            skip[0] += 1
        else:
            kept[0] += top
            text = []
            first = own == (RDF, "Description") and not any(s == own for s in stack)
            for k, v in attrs.items():
                key = _split(k)
                if key == (RDF, "about"):
                    v = ""
                elif key == ("adobe:ns:meta/", "xmptk"):
                    continue
                elif first and key[0] not in (RDF, "", "http://www.w3.org/XML/1998/namespace"):
                    if not keep(*key):
                        continue
                    kept[0] += 1
                text.append(f' {qname(key)}="{esc(v)}"')
            out.append(f"<{qname(own)}{''.join(text)}>")
        stack.append(own)

    def end(name):
        stack.pop()
        if skip[0]:
            skip[0] -= 1
        else:
            out.append(f"</{qname(_split(name))}>")

    def chars(t):
        if not skip[0] and t.strip():
            out.append(esc(t))

    p = _parser()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    try:
        _run(p, packet(data))
    except Malformed:
        return b""
    if not kept[0]:
        return b""
    spaces = "".join(f' xmlns:{v}="{esc(k)}"' for k, v in used.items())
    body = "".join(out)
    at = body.index(">")
    return (body[:at] + spaces + body[at:]).encode()


class ContainerItem(NamedTuple):
    semantic: str
    mime: str
    length: int
    padding: int


def directories(data: bytes) -> list[list[ContainerItem]]:
    """Directories of container items, by namespace, not prefix; bad numbers are malformed."""
    out: list[list[ContainerItem]] = []
    inside: list[str] = []

    def start(name, attrs):
        ns, local = _split(name)
        if ns in CONTAINERS and local == "Directory":
            out.append([])
            inside.append(ns)
        elif inside:
            own = {k: v for a, v in attrs.items() if (k := _split(a))[0] == CONTAINERS[inside[-1]]}
            if own:
                get = lambda k, d="": own.get((CONTAINERS[inside[-1]], k), d)
                try:
                    out[-1].append(ContainerItem(get("Semantic"), get("Mime"), int(get("Length", "0")), int(get("Padding", "0"))))
                except ValueError:
                    raise Malformed("container: bad number") from None

    def end(name):
        ns, local = _split(name)
        if inside and ns == inside[-1] and local == "Directory":
            inside.pop()

    p = _parser()
    p.StartElementHandler, p.EndElementHandler = start, end
    _run(p, packet(data))
    return out


def arrangement(items: list[ContainerItem], size: int, photo_end: int, from_end: bool = True) -> list[tuple[int, int]]:
    """Places (start, end) of the items after the photo: counted from the file's end, or one after the other from the photo's. Padding lies behind an item."""
    out, tail = [], items[1:]
    if from_end:
        at = size
        for i in reversed(tail):
            at -= i.length + i.padding
            out.append((at, at + i.length))
        out.reverse()
    else:
        at = photo_end + (items[0].padding if items else 0)
        for i in tail:
            out.append((at, at + i.length))
            at += i.length + i.padding
    if any(a < photo_end or b > size or a > b for a, b in out):
        raise Malformed("container: items do not fit")
    return out


# Elements that move, that hold HTML, and the order of reasons.
ANIMATION = {"animate", "animateColor", "animateMotion", "animateTransform", "set", "mpath", "discard"}
REASONS = ("script", "animation", "html", "css")


def uncheckable(data: bytes) -> str | None:
    """Why an SVG cannot be compared by rendering: script, animation, HTML or CSS, in this order; None if it can. Malformed if it is no XML."""
    found: set[str] = set()
    style = [0]

    def css(t: str) -> None:
        if re.search(r"@(?!charset)[a-zA-Z-]|var\(\s*--", t):
            found.add("css")

    def start(name, attrs):
        local = _split(name)[1]
        if local == "script" or any(_split(k)[1].lower().startswith("on") for k in attrs):
            found.add("script")
        if local in ANIMATION:
            found.add("animation")
        if local == "foreignObject":
            found.add("html")
        if "style" in attrs:
            css(attrs["style"])
        style[0] += local == "style"

    def end(name):
        style[0] -= _split(name)[1] == "style"

    def chars(t):
        if style[0]:
            css(t)

    def instruction(target, _):
        if target == "xml-stylesheet":
            found.add("css")

    p = _parser()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.ProcessingInstructionHandler = start, end, chars, instruction
    _run(p, data)
    return next((r for r in REASONS if r in found), None)


def root(data: bytes) -> str:
    """Name of the root element; the text must be well-formed."""
    names: list[str] = []
    p = _parser()
    p.StartElementHandler = lambda name, _: names.append(_split(name)[1]) if not names else None
    _run(p, data)
    return names[0]


def svg_violations(data: bytes, original: bytes) -> list[tuple[str, int]]:
    """A result must be UTF-8, well-formed, and have the original's root."""
    try:
        data.decode("utf-8")
        if root(data) != root(original):
            return [("another root element", -1)]
    except UnicodeDecodeError:
        return [("not UTF-8", -1)]
    except Malformed as e:
        return [(str(e), -1)]
    return []
