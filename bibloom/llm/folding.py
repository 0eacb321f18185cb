"""A lookup table that skips or folds each code point, and text batches as flat arrays of code points."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Traditional and variant characters that names and titles are often typed with, each before its plain form (fixed values).
VARIANTS = {
    pair[0]: pair[1]
    for pair in (
        "壇坛 論论 學学 報报 實实 踐践 機机 製制 護护 經经 濟济 評评 電电 氣气 農农 業业 營营 養养 醫医 藥药 檢检 驗验 計计 術术 會会 網网 獻献 資资 訊讯 庫库 "
        "雜杂 誌志 進进 際际 國国 華华 漢汉 圖图 書书 館馆 東东 應应 當当 現现 復复 習习 導导 據据 門门 鐵铁 與与 發发 環环 動动 腦脑 藝艺 診诊 兒儿 內内 產产 "
        "婦妇 觀观 統统 臨临 衛卫 編编 專专 線线 滙汇 匯汇 彙汇 數数 覽览 賢贤 態态 類类 級级 輯辑 區区 莊庄 鄉乡 嶺岭 島岛 灣湾 塢坞 它他 對对 響响 療疗 後后 "
        "個个 們们 從从 來来 間间 關关 係系 時时 長长 預预 測测 壓压 體体 質质 軟软 訓训 練练 擇择 選选 領领 樣样 縱纵 隊队 監监 點点 頭头 顯显 顱颅 負负 變变 "
        "種种 熱热 濃浓 場场 徑径 續续 視视 覺觉 聽听 閾阈 餵喂 鎮镇 傷伤 傳传 針针 補补 膠胶 聯联 絡络 離离 職职 齡龄 齒齿 齲龋 寫写 紙纸 課课 組组 規规 項项 "
        "納纳 橫横 斷断 調调 異异 訪访 遠远 臟脏 腎肾 龍龙 馬马 鳥鸟 魚鱼 風风 陳陈 張张 劉刘 趙赵 孫孙 錢钱 許许 謝谢 鄒邹 蘇苏 韓韩 楊杨 鄭郑 馮冯 "
    ).split()
}

SKIP, EXPANDS = 0, 0xFFFFFFFF


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) if x.isalnum())


@functools.cache
def table() -> np.ndarray:
    """Per code point: SKIP for what is no letter, digit or ideograph, else its NFKC lower-case form, or EXPANDS if that is several characters.

    Built by rule from the Unicode database: planes 0 and 1 one by one; ideographs of planes 2 and 3 stand for themselves,
    but for the compatibility block; nothing else beyond holds letters.
    """
    out = np.zeros(0x110000, dtype=np.uint32)
    out[0x20000:0x34000] = np.arange(0x20000, 0x34000, dtype=np.uint32)
    out[0x4E00:0x9FFF + 1] = np.arange(0x4E00, 0xA000, dtype=np.uint32)
    for block in (range(0x80), range(0x80, 0x4E00), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20)):
        for i in block:
            f = _folded(chr(i))
            out[i] = ord(f) if len(f) == 1 else EXPANDS if f else SKIP
    out[0xAC00:0xD7A4] = np.arange(0xAC00, 0xD7A4, dtype=np.uint32)
    return out


@functools.cache
def marks() -> np.ndarray:
    """Code points that combine with the letter before them."""
    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x300, 0x20000) if unicodedata.combining(chr(i))]] = True
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and each text's offset (one more than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Folded codes (SKIP where nothing counts), offsets, and the texts they belong to.

    The few texts with characters that fold to several, or with combining marks, are normalised first.
    """
    flat, at = codes(texts)
    f = table()[flat] if len(flat) else np.zeros(0, np.uint32)
    odd = np.flatnonzero((f == EXPANDS) | marks()[flat]) if len(flat) else []
    if len(odd):
        texts = list(texts)
        for i in np.unique(np.searchsorted(at, odd, side="right") - 1):
            texts[i] = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", texts[i]).casefold())
        flat, at = codes(texts)
        f = table()[flat]
        f[f == EXPANDS] = SKIP
    return f, at, texts
