"""Small seeded scenes."""

import numpy as np
import pandas as pd


def corridor(n_frames=12, seed=0):
    """A straight drive between two walls over flat ground; one block stands there for the first half only.

    Returns sensor-frame points, poses per frame (matrix columns), poses at
    twice the rate (quaternions), and the static world points.
    """
    rng = np.random.default_rng(seed)
    gx, gy = np.meshgrid(np.arange(-4, 12, 0.25), np.arange(-3, 3.01, 0.25))
    ground = np.c_[gx.ravel(), gy.ravel(), np.zeros(gx.size)]
    wx, wz = np.meshgrid(np.arange(-4, 12, 0.25), np.arange(0.25, 2, 0.25))
    walls = np.vstack([np.c_[wx.ravel(), np.full(wx.size, s), wz.ravel()] for s in (-3.1, 3.1)])
    bx, bz = np.meshgrid(np.arange(-0.4, 0.41, 0.1), np.arange(0.2, 1.4, 0.1))
    block = np.c_[np.full(bx.size, 6.03), bx.ravel(), bz.ravel()]
    static = np.vstack([ground, walls]) + rng.normal(0, 0.003, (len(ground) + len(walls), 3))
    session, rows, poses, fine = "2020-01-01-00-00-00", [], [], []
    phi, theta = np.meshgrid(np.arange(0.005, 2 * np.pi, np.radians(1.2)), np.radians(np.linspace(60, 120, 31)), indexing="ij")
    d = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], -1).reshape(-1, 3)
    for k in range(n_frames):
        t, sensor = 100.0 + 0.1 * k, np.array([0.1 * k, 0.0, 1.0])
        with np.errstate(divide="ignore"):
            ground_r = np.where(d[:, 2] < 0, -1 / d[:, 2], np.inf)
            wall_r = np.abs(3.1 / d[:, 1])
            block_r = np.where(d[:, 0] > 0, (6.03 - sensor[0]) / d[:, 0], np.inf)
        hit = block_r[:, None] * d + sensor
        inside = (np.abs(hit[:, 1]) < 0.45) & (hit[:, 2] > 0.15) & (hit[:, 2] < 1.45) & (k < n_frames // 2)
        r = np.minimum(np.minimum(ground_r, wall_r), np.where(inside, block_r, np.inf))
        world = r[:, None] * d + sensor
        ok = (r < 9) & ((world[:, 2] < 2) | (r < wall_r))
        p = (r[:, None] * d)[ok] * (1 + rng.normal(0, 0.0003, (ok.sum(), 1)))
        rows.append(pd.DataFrame({"session": session, "frame_ts": t, "id": np.arange(len(p)) + k * 100000,
                                  "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
        poses.append({"session": session, "frame_ts": t, **{f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)},
                      "t0": sensor[0], "t1": 0.0, "t2": 1.0})
    for k in range(2 * n_frames + 2):
        t = 99.975 + 0.05 * k
        fine.append({"session": session, "t": t, "px": (t - 100.0), "py": 0.0, "pz": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0})
    return pd.concat(rows), pd.DataFrame(poses), pd.DataFrame(fine), static, block
