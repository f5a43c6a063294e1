"""Small plain loops that state what the operators must compute."""

from __future__ import annotations

import numpy as np


def iou(a, b):
    w = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0)
    h = max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    area = lambda r: max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)
    return w * h / max(area(a) + area(b) - w * h, 1e-9)


def match(dets, boxes, threshold):
    """dets: (image, det_id, score, box); boxes: {image: [box]} -> {(image, det_id): iou of the match}"""
    taken, hits = set(), {}
    for image, det, _, box in sorted(dets, key=lambda d: (-d[2], d[0], d[1])):
        scores = [iou(box, g) for g in boxes.get(image, [])]
        if not scores:
            continue
        best = int(np.argmax(scores))
        if scores[best] >= threshold and (image, best) not in taken:
            taken.add((image, best))
            hits[image, det] = scores[best]
    return hits


def average_precision(dets, hits, npos):
    if npos == 0:
        return None
    order = sorted(dets, key=lambda d: (-d[2], d[0], d[1]))
    tp = np.cumsum([(d[0], d[1]) in hits for d in order])
    if not len(tp):
        return 0.0
    recall, precision = tp / npos, tp / np.arange(1, len(tp) + 1)
    levels = np.linspace(0, 1, 101)
    return float(np.mean([precision[recall >= t].max() if (recall >= t).any() else 0.0 for t in levels]))


def suppress(dets, threshold):
    kept = []
    for d in sorted(dets, key=lambda d: (-d[2], d[1])):
        if all(iou(k[3], d[3]) <= threshold for k in kept):
            kept.append(d)
    return {d[1] for d in kept}


def ece(conf, y, edges):
    total, n = 0.0, len(conf)
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        m = (conf > lo) & (conf <= hi) if i else (conf >= lo) & (conf <= hi)
        if m.any():
            total += m.sum() / n * abs(y[m].mean() - conf[m].mean())
    return total
