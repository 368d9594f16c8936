"""Numpy reference for per-query EER and AP, written from the public
description of a ROC curve with collinear points dropped and of average
precision with ties grouped. Used only by tests."""

import numpy as np


def clf_curve(y, s):
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    distinct = np.where(np.diff(s))[0]
    idx = np.r_[distinct, len(y) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    return fps.astype(float), tps.astype(float)


def eer(y, s):
    y, s = np.asarray(y, int), np.asarray(s, float)
    if y.sum() == 0 or y.sum() == len(y):
        return None
    fps, tps = clf_curve(y, s)
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps = fps[keep], tps[keep]
    fps, tps = np.r_[0, fps], np.r_[0, tps]
    fpr, fnr = fps / fps[-1], 1 - tps / tps[-1]
    i = int(np.nanargmin(np.abs(fnr - fpr)))
    return (fpr[i] + fnr[i]) / 2


def ap(y, s):
    y, s = np.asarray(y, int), np.asarray(s, float)
    fps, tps = clf_curve(y, s)
    if tps[-1] == 0:
        return 0.0
    precision = tps / (tps + fps)
    recall = tps / tps[-1]
    return float(np.sum(np.diff(np.r_[0, recall]) * precision))
