"""Defect synthesis: patches cut from annotated pictures, bags, random placement, pasting."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

from rasterlens.operators import kernels as k
from rasterlens.operators import pictures as p

#: What share of a patch must remain after it is trimmed; a pit must lie whole.
LEAST_SHARE = {"Scratch": 1 / 3, "Stain": 1 / 2}


@dataclass
class Patch:
    source: str
    index: int
    category: str
    image: np.ndarray
    mask: np.ndarray


def patches(source: str, image: np.ndarray, objects: list[tuple[str, list]], padding: int = 8) -> list[Patch]:
    """One patch for each object (category, points) with a usable polygon, numbered by category from 1."""
    seen: dict[str, int] = {}
    out = []
    for category, points in objects:
        if len(points) < 3:
            continue
        mask = k.fill_polygons([points], *image.shape[:2])
        if not mask.any():
            continue
        seen[category] = seen.get(category, 0) + 1
        part, cut = p.cropped([image, mask], mask, padding)
        out.append(Patch(source, seen[category], category, part, cut))
    return sorted(out, key=lambda x: (x.source, x.index, x.mask.shape))


class Bag:
    """Draws without replacement; what is left when it no longer suffices goes, and the whole pool comes back."""

    def __init__(self, pool: list, rng: random.Random, least: int = 3):
        if len(pool) < least:
            raise ValueError(f"{len(pool)} patches, {least} are needed")
        self.pool, self.rng, self.left = pool, rng, []

    def draw(self, n: int) -> list:
        if len(self.left) < n:
            self.left = self.rng.sample(self.pool, len(self.pool))
        out, self.left = self.left[:n], self.left[n:]
        return out


def valid_corners(region: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``y, x`` of the places where a mask lies wholly within a region, by one correlation."""
    h, w = region.shape[0] - mask.shape[0] + 1, region.shape[1] - mask.shape[1] + 1
    if h < 1 or w < 1:
        return np.empty((0, 2), int)
    over = np.fft.irfft2(np.fft.rfft2((~region).astype(float)) * np.conj(np.fft.rfft2(mask.astype(float), region.shape)), region.shape)
    return np.argwhere(over[:h, :w] < 0.5)


def placed(patch: Patch, silver: np.ndarray, inner: np.ndarray, avoided: np.ndarray, used: np.ndarray, rng: random.Random, tries: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """A place for a patch at a random angle: its final mask and the colours under it.

    A pit lies whole in the inner region, off avoided and used pixels. Others lie in the
    silver box and are trimmed; enough of them must remain. Too many tries are an error.
    """
    whole = patch.category not in LEAST_SHARE
    room = (inner & ~avoided if whole else silver) & ~used
    for _ in range(tries):
        colours, mask = p.turned_patch(patch.image, patch.mask, rng.uniform(0, 360))
        corners = valid_corners(room, mask) if mask.size else ()
        if not len(corners):
            continue
        y, x = corners[rng.randrange(len(corners))].tolist()
        full, there, here = p.pasted(silver.shape, mask, x, y)
        final = full if whole else full & inner & ~avoided
        if not whole and final.sum() < mask.sum() * LEAST_SHARE[patch.category]:
            continue
        canvas = np.zeros((*silver.shape, *colours.shape[2:]), colours.dtype)
        canvas[there] = colours[here]
        return final, canvas
    raise ValueError(f"no place for the {patch.category} of {patch.source} in {tries} tries")


def synthesised(image: np.ndarray, silver: np.ndarray, avoided: np.ndarray, chosen: list[Patch], seed: int, margin: float = 10.0) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """A picture with the chosen defects pasted into it, and (category, mask) of each."""
    rng, out, used, masks = random.Random(seed), image.copy(), np.zeros(silver.shape, bool), []
    inner = p.inset(silver, margin)
    for patch in chosen:
        final, colours = placed(patch, silver, inner, avoided, used, rng)
        out[final] = colours[final]
        used |= final
        masks.append((patch.category, final))
    if (used & avoided).any():
        raise ValueError("a defect lies in the avoided area")
    return out, masks


def synthesised_white(image: np.ndarray, silver: np.ndarray, avoided: np.ndarray, chosen: list[Patch], seed: int, base: dict[str, float], gradient: dict[str, float], outlines: dict[str, bool] | None = None) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """``synthesised``, with the defects whitened and, where a category's flag says so, outlined in red."""
    out, masks = synthesised(image, silver, avoided, chosen, seed)
    out = p.whitened(out, masks, base, gradient)
    for category, mask in masks:
        if (outlines or {}).get(category, False):
            out = p.red_annotation(out, mask)
    return out, masks
