"""Text profiles: the patterns and limits that a kind of document needs.

Operators take a profile, so the same code runs on legal acts and on plain prose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Java patterns.  Word characters are letters, digits and "_" of any script.
W = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# Structure markers in the order that breaks ties; group 1 is the label, group 2 the title.
MARKERS = {
    "capitulo": (rf"(?m)^\s*(CAP[ÍI]TULO\s+[IVXLCDM]+){EDGE}\s*[–\-]?\s*(.*)$", 1),
    "secao": (rf"(?m)^\s*(Se[çc][ãa]o\s+[IVXLCDM]+){EDGE}\s*[–\-]?\s*(.*)$", 2),
    "artigo": (rf"(?m)^\s*(Art\.\s*\d+[ºo°]?){EDGE}", 3),
    "paragrafo": (rf"(?miu)^\s*(§\s*\d+[ºo°]?|Parágrafo\s+único){EDGE}", 4),
    "anexo": (rf"(?m)^\s*(ANEXO(?:\s+[IVXLCDM]+)?){EDGE}\s*[–\-]?\s*(.*)$", 0),
    "quadro": (rf"(?m)^\s*(Quadro\s+\d+){EDGE}\s*[–\-:]?\s*(.*)$", 5),
    "tabela": (rf"(?m)^\s*(Tabela\s+\d+){EDGE}\s*[–\-:]?\s*(.*)$", 5),
}

# Lines of legal acts that carry no content.
BOILERPLATE = (
    r"(?miu)^\s*{name}\s*[–\-]\s*{agency}\s*$",
    r"(?miu)^\s*(?:P\.|Fl\.)\s*\d+\s*Nota\s+T[ée]cnica\s+n[ºo°]\s*[\d/\-]+.*$",
    r"(?miu)^\s*\*\s*A\s+Nota\s+T[ée]cnica\s+é\s+um\s+documento\s+emitido\s+pelas\s+Unidades.*?Agência\.\s*$",
    r"(?m)^\s*_{20,}\s*$",
    r"(?m)^\s*Superintendência\s+de\s+[^\n]{0,80}–\s*[A-Z]{2,5}/{agency}\s*$",
    r"(?m)^\s*Processo\s+n[ºo°]\s*\d{5,}\.\d{4,6}/\d{4}-\d{2}\s*$",
    r"(?m)^\s*Este\s+texto\s+não\s+substitui\s+o\s+publicado\s+no\s+Boletim\s+Administrativo.*$",
    r"(?miu)^\s*Retificado\s+no\s+D\.O\.\s+de\s+\d{1,2}\.\d{1,2}\.\d{4}\.?\s*$",
    r"(?miu)^\s*\(Tornada\s+sem\s+efeito\s+pela.*\)\s*$",
    r"(?m)^\s*Texto\s+Original\s*$",
)

# First lines of acts, and what ends the summary below them.
TITLES = (
    r"(?iu)^RESOLU[ÇC][ÃA]O\s+(?:NORMATIVA|HOMOLOGAT[ÓO]RIA|AUTORIZATIVA)\s+(?:{agency}\s+)?N[ºo°]?\s*\S+",
    r"(?iu)^PORTARIA\s+(?:{agency}\s+)?N[ºo°]?\s*\S+",
    rf"(?iu)^DESPACHO(?:\s+{W}+){{0,3}}\s+N[ºo°]?\s*\S+",
    r"(?iu)^Nota\s+T[ée]cnica\s+n[ºo°]?\s*\S+",
    r"(?iu)^VOTO\s*$",
)
SUMMARY_STOP = r"(?iu)^(?:Voto|Texto\s+Original|O\s+DIRETOR|O\s+SUPERINTENDENTE|resolve:|I\s*[-–.])"
PROCESS_NUMBER = r"(?iu)PROCESSO\s*(?:n[ºo°]?\s*)?[:.]?\s*(\d{5,})\.\s*(\d{4,6})\s*/\s*(\d{4})\s*-\s*(\d{2})"
FOOTNOTE = (
    r"(?ms)^\s*(\d{1,3})\s+((?:Documento\s+SIC|SIC|Concessionária\s+até|Essas\s+usinas|Nota\s+Técnica\s+n[ºo°]).*?)"
    r"(?=\n\s*\n|\n\s*\d{1,3}\s+(?:Documento|SIC|Concessionária|Nota)|\z)"
)
# Act types that questions are drawn from, and the texts of the generator.
PRIORITY_TYPES = ("ren", "reh", "prt", "dsp", "area", "vot")
#: What an answer says if the texts don't hold it, and the answer without any text.
NOT_FOUND = "Não encontrei informação suficiente"
NO_ANSWER = NOT_FOUND + " nos documentos para responder esta pergunta."


@dataclass(frozen=True)
class TextProfile:
    """What differs between kinds of documents."""

    paragraph: str = r"\n\s*\n+"
    markers: dict[str, tuple[str, int]] = field(default_factory=lambda: dict(MARKERS))
    boilerplate: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    base_url: str = ""
    target_tokens: int = 500
    overlap_tokens: int = 50
    most_tokens: int = 1500
    chars_per_token: int = 4
    least_chars: int = 60
    least_preamble: int = 200


def legal_profile(agency: str, agency_name: str, base_url: str = "") -> TextProfile:
    """Acts of an agency, named by its acronym and by a pattern for its full name."""
    fill = lambda x: x.replace("{agency}", agency).replace("{name}", agency_name)
    return TextProfile(boilerplate=tuple(map(fill, BOILERPLATE)), titles=tuple(map(fill, TITLES)), base_url=base_url)


#: Prose whose paragraphs are its lines.
PLAIN = TextProfile(paragraph=r"\n+", boilerplate=(r"(?m)^\s*Released under the [A-Za-z0-9 .\-]+License\.?\s*$", r"(?m)^\s*Copyright .*$"))
